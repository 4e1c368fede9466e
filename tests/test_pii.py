"""Personal data over long media, and the lists of words that the rules read."""

from threading import Timer

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans.catalogue import QUERIES
from tessera.sources.adapters import doc_word_lists, doc_words


def test_work_grows_as_the_words_do(spark):
    # A window that looks ahead to a medium's end asked n * n / 2 words here, 2e10; the job is given up after 90 seconds.
    said = F.array(*map(F.lit, ("officer", "Dana", "at", "42", "Old", "Mill", "Road", "so", "plate", "of", "abc", "12", "born", "in", "May", "1990")))
    word = F.get(said, (F.col("id") % 16).cast("int"))
    w = spark.range(200_000).select(F.lit(1).alias("media_id"), F.col("id").alias("idx"), word.alias("word"), text.norm_token(word).alias("norm"), (F.col("id") * 0.5).alias("start_s"), (F.col("id") * 0.5 + 0.4).alias("end_s"))
    stop = Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = {(r.kind, r.text): (r.n, r.first, r.last) for r in text.pii_suggestions(w).groupBy("kind", "text").agg(F.count("*").alias("n"), F.min("start_s").alias("first"), F.max("end_s").alias("last")).collect()}
    finally:
        stop.cancel()
    n = 12_500
    assert got == {
        ("name", "Dana"): (n, 0.5, 99_992.9), ("address", "42 Old Mill Road"): (n, 1.5, 99_995.4),
        ("plate", "abc 12"): (n, 5.0, 99_997.9), ("dob", "May 1990"): (n, 7.0, 99_999.9),
    }


def test_lists_are_the_words_of_documents(spark, tmp_path):
    rows = [
        (1, "My name is  Dana ''Reed'' o'clock\tÉCOLE ΑΣ. İx x́  y 12, a_b"), (2, " lead and trail "), (3, ""), (4, None), (5, "' '' 'a b'"),
        (6, "officer Dana Reed born in May 1990"), (7, "mail a@b.org twice"), (7, "mail a@b.org twice"), (8, "call five five five one two three four"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {r[0]: ([x.word for x in r[1]], [x.norm for x in r[1]]) for r in doc_words(spark, str(tmp_path)).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("idx", "word", "norm")))).collect()}
    got = {r.media_id: (r.words, r.norms) for r in doc_word_lists(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 7
    cols = ("media_id", "kind", "i0", "i1", "start_s", "end_s", "text", "score")
    told = [sorted(tuple(r) for r in df.select(*cols).collect()) for df in (QUERIES["pii_all_claimed"](spark, str(tmp_path)), text.pii_suggestions(doc_words(spark, str(tmp_path))))]
    assert told[0] == told[1] and {(r[0], r[1], r[6]) for r in told[0]} == {
        (1, "name", "Dana"), (6, "name", "Dana Reed"), (6, "dob", "May 1990"), (7, "email", "a@b.org"), (8, "phone", "five five five one two three four"),
    }
    assert sum(r[0] == 7 for r in told[0]) == 2
