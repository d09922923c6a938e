import random

import corpus_pipeline

FOREIGN = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
)
CLEAN = (
    "The cat and the dog", "The children went to the house", "Das ist ein Hund", "El perro come en la casa",
    "All human beings are born free and equal in dignity and rights.", "Alle Menschen sind frei und gleich an Würde und Rechten geboren.",
    "Todos los seres humanos nacen libres e iguales en dignidad y derechos.", "Tous les êtres humains naissent libres et égaux en dignité et en droits.",
)


def test_foreign_and_random_latin_goes_and_clean_documents_stay(spark):
    rng = random.Random(2)
    noise = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n)) for letters in ("asdfghjkl", "abcdefghijklmnopqrstuvwxyz") for n in (15, 40, 200)]
    noise += [" ".join(f"{rng.getrandbits(256):064x}" for _ in range(n)) for n in (2, 5)]
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = [(-1 - k, t, None, "p", len(t)) for k, t in enumerate([*FOREIGN, *noise])] + [(-101 - k, t, None, "p", len(t)) for k, t in enumerate(CLEAN)]
    own = spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.by_language(spark, docs.unionByName(own.select(*docs.columns)), sf).select("doc_id").collect()}
    assert {k for k in kept if k < 0} == {-101 - k for k in range(len(CLEAN))}
    assert {k for k in kept if k >= 0} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_documents_of_the_small_table_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.by_language(spark, docs, sf).count() == docs.count()
