"""A corpus pipeline of five stages, each a DataFrame operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyweave.llm import language, mixing, sentencepieces, simhash, similar, suffixes
from skyweave.llm.queries import MODEL
from skyweave.llm.store import write

#: Language scores below this are of no learned language, in texts too short for more.
LEAST_SCORE = 0.1
#: Scores fall with the distinct n-grams of a text, so the bound does: n-grams, least score, between them in proportion.
#: Calibrated on windows of the labelled documents of sf0.01 against other languages and random letters, see README.
LEAST_SCORES = ((8, LEAST_SCORE), (16, 0.3), (24, 0.34), (55, 0.34), (90, 0.315), (115, 0.3), (225, 0.3), (325, 0.27), (450, 0.24), (700, 0.2))
#: What SQL can't express: profiles, fingerprints, suffixes, a random tree, a tokenizer.
ORACLE_SQL = None


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*[f"`{c}`" for c in docs.columns])


def _least(n: Column) -> Column:
    """The bound for texts of ``n`` distinct n-grams."""
    out = F.lit(LEAST_SCORES[-1][1])
    for (a, low), (b, high) in reversed(list(zip(LEAST_SCORES, LEAST_SCORES[1:], strict=False))):
        out = F.when(n < b, low + (F.greatest(n, F.lit(a)) - a) * ((high - low) / (b - a))).otherwise(out)
    return out


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without a letter, or far from each, go.  Nothing labelled: all with a letter stay."""
    profiles = language.fit(docs, "doc_id", "text", "lang")
    marked = language.identify(docs, "text", profiles, "__lang", "__score", keep=True, distinct="__n")
    return _like(docs, marked.where((F.col("__lang") != language.UNDETERMINED) & (F.col("__score") >= _least(F.col("__n")))) if profiles.languages else docs.where(F.col("text").rlike(r"\p{L}")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; copies share 0.8 of their 5-word shingles."""
    return _like(docs, simhash.keep_one(docs, "doc_id", "text", found=similar.near_copies(docs, "doc_id", "text")))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated passages; parts of characters at their edges go too.  Counts of characters follow."""
    cut = suffixes.remove_repeats(docs, "doc_id", "text", as_text=True).withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _like(docs, cut)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix copies it, which may be never."""
    size = mixing.word_count(F.col("text"))
    drawn = mixing.mix(docs, "doc_id", "source", size)
    per = drawn.groupBy(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    counts = write(per.agg(F.count("*").alias("__n"), F.sum("copies").alias("__copies")).where("__copies > 0"), "copies").df
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (size == F.col("__size"))
    # of n equal rows each gets its share of the copies, the first ones one more
    # merge joins at every size: the counts grow with the input
    alone = docs.join(counts.where("__n = 1").hint("merge"), same).withColumn("__mine", F.col("__copies"))
    own = W.partitionBy("__id", "__source", "__size").orderBy("text")
    several = docs.join(counts.where("__n > 1").hint("merge"), same).withColumn("__k", F.row_number().over(own))
    share = F.floor(F.col("__copies") / F.col("__n")) + F.when(F.col("__k") <= F.col("__copies") % F.col("__n"), 1).otherwise(0)
    several = several.withColumn("__mine", share).where("__mine > 0").drop("__k")
    return _like(docs, alone.unionByName(several).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mine")))))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, their number, and ``text``, decoded from them."""
    model = sentencepieces.load(MODEL)
    ids = sentencepieces.encode(docs.select("doc_id", "text"), "text", model, decoded="text")
    return ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "text")


STAGES = [("language", by_language), ("near copies", without_near_copies), ("repeats", without_repeats), ("mix", mixed), ("tokens", tokenized)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder before the next reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        table = write(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before:
            before.drop()
        docs, before = table.df, table
    return STAGES[-1][1](spark, docs, sf_dir)
