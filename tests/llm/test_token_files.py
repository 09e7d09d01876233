import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import token_files

ODD = [(900, "naïve café’s — 東京 don't  \n\n x=1;\tУра! ​😀 ½"), (901, "<|endoftext|> it's"), (902, "é ǅ   \r\n"), (903, "ab" * 40_000)]


def expected(rows, path):
    tokenizer, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def key(row):
    return (row[1], row[2])


def test_query_against_the_library(spark, make_docs, mixed_rows, tmp_path):
    rows = [*mixed_rows, *ODD]
    make_docs(rows).repartition(5).withColumn("ids", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    found = token_files.op3_token_orc(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found), key=key) == expected(rows, public_tokenizers.path("byte_bpe_50k.json"))


def test_read_by_predicate(spark, make_docs, mixed_rows, tmp_path):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(token_files.encode_sorted(make_docs(mixed_rows), tokenizer), str(tmp_path / "ids"))
    every = token_files.read_token_files(spark, str(tmp_path / "ids"))
    some = token_files.read_token_files(spark, str(tmp_path / "ids"), F.col("doc_id") == 301)
    assert every.count() == len(mixed_rows)
    assert [list(r.ids) for r in some.collect()] == [[*Tokenizer.from_file(tokenizer).encode(dict(mixed_rows)[301], add_special_tokens=False).ids, 0]]


def test_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert token_files.op3_token_orc(spark, str(tmp_path)).count() == 0


def orc_reader(spark, path):
    jvm = spark._jvm
    return jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(path)), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))


def rows_scanned(df):
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().get("numOutputRows").get().value()


def test_stripes_indexes_filters_and_pruning(spark, make_docs, tmp_path):
    rows = [(2 * k, f"document {k} " + " ".join(str(k * n % 9973) for n in range(40))) for k in range(20_000)]
    at = tmp_path / "ids"
    encoded = token_files.encode_sorted(make_docs(rows), public_tokenizers.path("byte_bpe_50k.json")).coalesce(1)
    token_files.write_token_files(encoded, str(at), stripe_bytes=512 << 10)
    (file,) = at.glob("*.orc")
    reader = orc_reader(spark, file)
    stripes = list(reader.getStripes())
    assert len(stripes) > 1 and sum(s.getNumberOfRows() for s in stripes) == len(rows) and reader.getRowIndexStride() == 1000
    names = list(reader.getSchema().getFieldNames())
    for stripe in stripes:
        footer = reader.rows().readStripeFooter(stripe)
        kinds = {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
        assert ("BLOOM_FILTER_UTF8", 1 + names.index("doc_id")) in kinds and not [k for k in kinds if k[0] == "BLOOM_FILTER_UTF8" and k[1] != 1 + names.index("doc_id")]
        assert {("ROW_INDEX", c) for c in range(len(names) + 1)} <= kinds
        encodings = [footer.getColumns(c).getKind().toString() for c in range(footer.getColumnsCount())]
        assert encodings[1 + names.index("doc_id")] == encodings[-1] == "DIRECT_V2"  # integer run lengths, version 2
    one = token_files.read_token_files(spark, str(at), F.col("doc_id") == 2 * 7_777)
    assert one.count() == 1 and rows_scanned(one) <= 1_000  # one row group
    assert rows_scanned(token_files.read_token_files(spark, str(at), F.col("doc_id") == 2 * 7_777 + 1)) == 0  # within the bounds, not in the filter
    assert rows_scanned(token_files.read_token_files(spark, str(at), F.col("doc_id") > 10**6)) == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600k")
    try:
        parts = token_files.read_token_files(spark, str(at))
        sizes = [n for n in parts.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
        assert len(sizes) > 1 and sum(sizes) == len(rows)  # stripes are read by several tasks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


BLANKS = ["", " ", "  ", "\n", " \n", "\n ", "a ", " a", "a  b", "a \n b", "a\n b", "a\n  b", "a \nb", "a\t b \t", "\n \n", "a\n \n b", "a \n", "a\n ", "x. y,\n\nZ 1 's don't 's", "a   ", "\r\n b", "  a", "\t a", " \t a"]


def test_blanks_of_all_kinds_and_few_kept_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.Encoder(path)
    texts = [*BLANKS, *(t for _, t in ODD), *(f"{a}{b} c{a}" for a in BLANKS for b in BLANKS)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.encode(pa.array(texts)).to_pylist() == expected
    own.words.most = 40  # a few words: what was kept goes again and again
    for at in range(0, len(texts), 7):
        assert own.encode(pa.array(texts[at : at + 7])).to_pylist() == expected[at : at + 7]
    assert own.encode(pa.array([], type=pa.string())).to_pylist() == []


def test_recurring_stretches_are_cut_once(monkeypatch):
    scanned = []

    class Counting:
        def findall(self, text, own=token_files.PRE_TOKEN):
            scanned.append(len(text))
            return own.findall(text)

    monkeypatch.setattr(token_files, "PRE_TOKEN", Counting())
    path, text = public_tokenizers.path("byte_bpe_50k.json"), "the cats, and the dogs. " * 5_000
    own = token_files.Encoder(path)
    found = own.encode(pa.array([text, text]))
    assert sum(scanned) < 100
    assert found.to_pylist() == [Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids] * 2


def test_long_rows_among_short_ones_are_dealt_in_order():
    texts = ["a", "b" * 90, "c", "d", "e" * 40, "f"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3)), pa.array(texts[k : k + 3])], names=["doc_id", "text"]) for k in (0, 3)]
    found = [b.column(1).to_pylist() for b in token_files.of_size(iter(batches), 30)]
    assert found == [["a", "b" * 90], ["c", "d", "e" * 40], ["f"]]
