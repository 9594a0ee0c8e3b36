import re

from lakeseek.functions.text import STOP_WORDS, clean_text
from lakeseek.plans import queries as Q


def brute(t):
    words = re.sub(r"[^A-Za-z0-9]+", " ", re.sub(r"[^\x00-\x7f]", "", t)).split(" ")
    return " ".join(w for w in words if w and w not in STOP_WORDS)


def test_non_ascii_texts(spark):
    want = {
        "Größe und Maß": "Gre und Ma", "L’été à Orléans": "Lt Orlans", "but the naïve café": "nave caf", "終わり。": "", "a 終 b": "b",
        "İstanbul K9": "stanbul K9", "snake_caſe": "snake cae", "Done! 🙂 It's": "Done It s", "tab\u200bbed": "tabbed", "": "", "THE": "THE", "they will, d": "",
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", clean_text(df["t"]).alias("c")).collect()}
    assert got == want == {t: brute(t) for t in want}


def test_every_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null").collect()
    got = {r["doc_id"]: r["cleaned"] for r in Q.queries()["cleaned_text"](spark, data).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in docs}
    assert len([r for r in docs if not r["text"].isascii()]) > 0
