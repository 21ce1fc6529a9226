import pytest

#: Documents with what data can throw at an operator: nulls in every column, empty and blank texts, repeated rows, one id
#: with two texts, ties, a long text, and columns whose names the operators use themselves.
LONG = " ".join(f"word{i % 997} of the long text" for i in range(6000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
    (2, None, "en", "a", None),
    (3, "", None, "a", 0),
    (4, " \n\t ", "de", None, 4),
    (5, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
    (5, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
    (6, "Für die Übung nicht und der das von mit ist.", "de", "b", 44),
    (6, "Un autre texte pour le même numéro, avec des mots français.", "fr", "b", 58),
    (7, LONG, "en", "b", len(LONG)),
    (None, "A document without a number, password = hunter2hunter2.", "en", "b", 55),
    (8, "日本語のテキスト\u3000です。 مرحبا 🙂 \x00 end", None, None, 30),
    (9, "Für die Übung nicht und der das von mit ist.", "de", "b", 44),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    clash = ("_row", "_text", "_doc", "words", "n_words", "score", "spans", "host", "kept", "bucket", "doc", "fp", "node", "size", "key", "at", "items", "lang_pred")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")
