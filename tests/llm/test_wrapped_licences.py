import textwrap

import pytest

from skyweave.llm import licences


@pytest.fixture(scope="module")
def model():
    return licences.train(["The children went to the house and saw the dog.", "A long winter came over the old town."])


@pytest.mark.parametrize("marker", ["", "# ", " * ", "// ", "-- "])
def test_wrapped_templates_are_confirmed_once(model, marker):
    for family, notices in licences.TEMPLATES.items():
        for t in notices:
            lines = textwrap.wrap(t, 72)
            text = "\n".join(["The children went home.", "", *[marker + x for x in lines], "", "A long winter came."])
            count, found = model.scan(text)
            assert count == len(lines) + 2
            assert [(f["family"], f["paragraph"]) for f in found if f["confirmed"]] == [(family, 1)], (t, found)


def test_blank_lines_part_notices(model):
    lines = textwrap.wrap(licences.TEMPLATES["MIT"][2], 72)
    assert not any(f["confirmed"] for f in model.scan("\n#\n".join(lines))[1])
