"""The white space that separates words, as bytes 0x20 and 0x09 to 0x0D."""

WORD = r"[^\x20\x09-\x0D]+"
