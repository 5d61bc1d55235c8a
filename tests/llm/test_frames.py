"""Every operator over frames with clashing extra columns, nulls and very long texts."""

from public_tokenizers import path
from pyspark.sql import functions as F

from cloneframe.llm import warc
from cloneframe.llm.bpe import round_trip
from cloneframe.llm.hmm import score_documents
from cloneframe.llm.html_text import extract
from cloneframe.llm.minhash_forest import near_duplicates
from cloneframe.llm.packing import pack
from cloneframe.llm.pii import pseudonymise
from cloneframe.llm.quality import measure, train
from cloneframe.llm.sketch import fingerprints
from cloneframe.llm.substring_dedup import remove_repeats

def extra():
    return {"id": F.lit(1), "a": F.lit("x"), "b": F.lit(None).cast("string"), "key": F.lit(2), "rk": F.lit(3), "_n": F.lit(4), "block": F.lit(5), "sig": F.lit(b"s"), "start": F.lit(6), "c": F.lit(7), "node": F.lit(8), "component": F.lit(9), "value": F.lit("v"), "spans": F.lit("s"), "_rk": F.lit(10), "_found": F.lit("f"), "_made": F.lit("m"), "_values": F.lit("z"), "text2": F.lit("t"), "list": F.lit("l"), "a.b": F.lit("dot"), "_b": F.lit(1), "_t": F.lit(2), "_i": F.lit(3), "_e": F.lit(4), "bucket": F.lit(5), "tail": F.lit(6)}


def frame(spark):
    long = " ".join(f"w{i % 5000}" for i in range(120_000))
    rows = [(1, long), (2, long + " end"), (3, None), (4, ""), (None, "a b c"), (5, "x" * 300_000), (6, "\n".join(["same line of words here"] * 2000))]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra())


def test_documents(spark):
    docs = frame(spark)
    n = docs.count()
    private = pseudonymise(docs, "k")
    assert private.count() == n and private.drop("n_private", "text").exceptAll(docs.drop("text")).isEmpty()
    near = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert near[2].component_id == 1 and near[3].n_shingles == 0 and near[3].kept and len(near) == n
    assert pack(docs, path("byte_bpe_50k.json")).select("doc_id").distinct().count() == n
    assert fingerprints(docs).count() == n
    got = measure(docs, train(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert got.count() == n and set(docs.columns) <= set(got.columns)
    assert score_documents(docs, states=2, classes=64, passes=1).count() == n
    less = remove_repeats(docs)
    assert less.select(*(f"`{c}`" for c in docs.columns if c != "text")).exceptAll(docs.drop("text")).isEmpty()
    cut = {r.doc_id: r for r in less.collect()}
    assert cut[1].n_removed == 120_000 and cut[2].n_removed == 120_000 and cut[3].text is None and cut[6].n_removed == cut[6].n_words
    assert round_trip(docs, path("word_bpe_49k.json")).count() == n


def test_pages(spark, tmp_path):
    pages = frame(spark).withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumns({"url": F.lit(None).cast("string"), "digest": F.lit("d"), "refers_to": F.lit(1)})
    assert extract(pages).count() == 7
    warc.write(pages, f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 7
