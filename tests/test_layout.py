"""Files of any size, postings, and bounds that the database tells."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ingest, search
from corpusloom.plans import lexicon
from corpusloom.sources import corpus, files, postings

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_file_in_several_tasks_has_the_sentences_of_its_whole_text(spark, tmp_path):
    texts = {"a.txt": "Первая строка… Вторая!  Третья\n\nbro\rken\x00 line. " * 400 + "\r\n Last ", "b.txt": "", "c.txt": "\n.\n!?\nOne", "d.txt": "x. " * 5_000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = files.read_sentences(spark, str(tmp_path))
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = sorted((r.path.rsplit("/", 1)[1], r.pos, r.sentence) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    whole = spark.createDataFrame([(k, t.replace("\x00", "")) for k, t in enumerate(texts.values())], "text_id long, text string")
    names = list(texts)
    assert got == sorted((names[r.text_id], r.pos, r.sentence) for r in ingest.split_sentences(whole).collect())


@pytest.fixture(scope="module")
def stored(spark):
    return lexicon.stored_corpus(spark, DATA, "the, and, und, les, que")


def test_a_look_up_reads_the_row_groups_of_its_token(spark, stored, tmp_path):
    path = str(tmp_path / "postings")
    postings.write_postings(stored, path, row_group=1 << 12)
    read = postings.read_postings(spark, path)
    assert rows_of(read.select("cross_id", "word_id", "sentence_id", "text_id", "token_id")) == rows_of(stored.cross)
    total, own = read.count(), read.where("token = 'les'").count()

    def scanned(df):
        df.collect()
        nodes, found = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                nodes.append(node.executedPlan())
            if node.getClass().getSimpleName() == "FileSourceScanExec":
                found += node.metrics().apply("numOutputRows").value()
            children = node.children()
            nodes += [children.apply(k) for k in range(children.size())]
        return found

    for token in ("les", "absent"):
        assert scanned(read.where(F.col("token") == token)) < total / 2
    assert scanned(read.where("token = 'les'")) >= own > 0
    for distinct in (True, False):
        want = search.concordance(stored.cross, stored.words, stored.tokens, stored.sentences, None, "les", distinct).select("text_id", "sentence_id", "word", "pos", "shown")
        assert rows_of(search.concordance_of_postings(read, stored.sentences, None, "Les".lower(), distinct).select(*want.columns)) == rows_of(want)
    one = stored.cross.join(stored.tokens.where("token = 'les'"), ["text_id", "token_id"]).first().text_id
    want = search.concordance(stored.cross, stored.words, stored.tokens, stored.sentences, one, "les")
    assert rows_of(search.concordance_of_postings(read, stored.sentences, one, "les").select("sentence_id", "word_id", "shown")) == rows_of(want.select("sentence_id", "word_id", "shown"))


def test_bounds_come_from_the_database(spark, tmp_path):
    rows = [(k, f"T{k}", "A", 1900, "g", f"The smoke of {k}. The end.") for k in range(1, 41)]
    texts = spark.createDataFrame(rows, "text_id long, title string, author string, year int, genre string, text string")
    small = lexicon.run_analysis(spark, texts, "smoke, absent").corpus
    url, driver, names = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, {"cross": '"cross"'}
    corpus.write_corpus_jdbc(small, url, driver, connections=2, names=names)
    assert corpus.jdbc_bounds(spark, url, driver, names, rows_a_task=15)["texts"] == ("text_id", 1, 40, 3)
    assert corpus.jdbc_bounds(spark, url, driver, names) == {}
    back = corpus.read_corpus_jdbc(spark, url, driver, names=names, rows_a_task=15)
    assert back.texts.rdd.getNumPartitions() == 3 and back.sentences.rdd.getNumPartitions() == 6
    for name in corpus.SCHEMAS:
        assert rows_of(getattr(back, name).select(*getattr(small, name).columns)) == rows_of(getattr(small, name))
