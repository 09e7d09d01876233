"""op4 against the library, over whole tables and odd texts."""

import hashlib
import random
import zlib
from struct import pack, unpack

import public_tokenizers
import pyarrow as pa
import sentencepiece

from corpusloom.llm import sentencepiece_fst as fst

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  two  blanks ", "\n\n", "a\nb\n", "aaaaaaaaaaaaaaaaaaaaa", "....,,,;;;::: ... !!!???", "x" * 3000, "Straße naïve ½ ² ⁂",
    "汉字漢字かなカナ", "🙂🙂👩‍👩‍👧", "éä", "\t tab\ttab", "▁ ▁▁x▁", "the the, the. The", "http://a.b/c?d=e&f=[g]{h}", "abab" * 400, "\x00\x01\x7f", "don't they're",
]


def brute(text):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = model.encode(text or "")
    return ids, model.decode(ids)


def test_odd_texts_and_repeats(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, "a copy", "x"), (0, "a copy", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = fst.decode(fst.encode(docs, MODEL), MODEL).collect()
    expected = sorted((i, *brute(t)) for i, t, _ in rows)
    assert sorted((r.doc_id, list(r.ids), r.text) for r in found) == expected


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fst.decode(fst.encode(docs, MODEL), MODEL).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    for d in docs:
        ids, text = brute(d.text)
        expected[d.doc_id] = (len(ids), zlib.crc32(pack(f"<{len(ids)}i", *ids)), hashlib.sha256(text.encode()).hexdigest())
    found = fst.op4_sentencepiece(spark, DATA).collect()
    assert {r.doc_id: (r.n_pieces, r.ids_crc32, r.decoded_sha256) for r in found} == expected
    assert len(found) == len(docs)


def message(*parts):
    """A protocol-buffer message of (field, value) parts: whole numbers, floats, bytes."""
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for field, value in parts:
        if isinstance(value, float):
            out += number(field << 3 | 5) + pack("<f", value)
        elif isinstance(value, int):
            out += number(field << 3) + number(value)
        else:
            out += number(field << 3 | 2) + number(len(value)) + value
    return out


def unigram_model(path, pieces, bytes_too, rules=b"", squeeze=0):
    """A weighted model written by hand: nothing is trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if bytes_too else []
    rows += [(p, float(s), 1) for p, s in pieces.items()]
    spec = [(1, message((1, p.encode()), (2, s), (3, t))) for p, s, t in rows]
    trainer = message((3, 1), *([(35, 1)] if bytes_too else []), (40, 0), (41, 1), (42, 2))
    normaliser = message((1, b"own"), *([(2, rules)] if rules else []), (3, 1), (4, squeeze), (5, 1))
    path.write_bytes(message(*spec, (2, trainer), (3, normaliser)))
    return str(path)


PIECES = {
    "▁": -3.1, "a": -4.0, "b": -4.2, "c": -4.9, "d": -5.3, "ab": -5.1, "bc": -5.7, "abc": -7.9, "cd": -6.0, "abcd": -12.3, "▁a": -4.4, "▁ab": -6.5, "▁abc": -8.8,
    "da": -7.3, "dab": -9.1, ".": -4.6, "c.": -8.0, "▁▁": -6.9, "fi": -6.1, "f": -6.6, "i": -6.7, "1": -5.9, "\n": -7.7,
}


def test_weights_decide_between_paths(tmp_path):
    rng = random.Random(3)
    texts = ["abcd", "abcdabcd abc. dab", "", " ", "  a  b ", "xyz abc xx a", "a\nb\n\nab", "aéb", "\n"] + ["".join(rng.choice("aabbccdd. x\nfi1") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for bytes_too in (True, False):
        path = unigram_model(tmp_path / f"{bytes_too}.model", PIECES, bytes_too)
        library, own = sentencepiece.SentencePieceProcessor(model_file=path), fst.Transducer(path)
        assert not own.merges
        for text in texts:
            ids = list(unpack(f"<{len(own.encode(text)) // 4}i", own.encode(text)))
            assert ids == library.encode(text), text


def test_the_cheapest_of_all_paths_is_found(tmp_path):
    own = fst.Transducer(unigram_model(tmp_path / "u.model", PIECES, True))

    def every(text):
        if not text:
            yield 0.0, ()
        for end in range(1, len(text) + 1):
            if text[:end] in PIECES:
                yield from ((cost - own.score[own.pieces[text[:end]]], (text[:end], *path)) for cost, path in every(text[end:]))

    for text in ("abcdabcd", "▁abcdab", "dabcab.", "bcbcbcbc", "abcabcd"):
        assert own._search(text) == list(min(every(text))[1])


def test_scores_above_zero(tmp_path):
    rng = random.Random(5)
    path = unigram_model(tmp_path / "p.model", {p: s + 9.5 for p, s in PIECES.items()}, True)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), fst.Transducer(path)
    for text in ["abcdabcd", "fi1é."] + ["".join(rng.choice("aabbccdd. x\nfi1") for _ in range(rng.randint(1, 40))) for _ in range(200)]:
        assert list(unpack(f"<{len(own.encode(text)) // 4}i", own.encode(text))) == library.encode(text), text


def test_the_acceptor_leaves_one_finite_path():
    own = fst.Transducer(MODEL)

    def finite(text, before=""):
        if not text:
            yield ()
        for end in range(1, len(text) + 1):
            if (text[:end] in own.pieces or end == 1) and own._join(before, text[:end]) == 0.0:
                yield from ((text[:end], *path) for path in finite(text[end:], text[:end]))

    for text in ("▁the", "▁thethe", "▁unreadable", "▁x汉\u0378y", "aaaaaaa", "▁▁▁", "...,,"):
        assert [own._search(text)] == [list(path) for path in finite(text)], text


def test_normalisers_are_compiled(tmp_path):
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    rules = dict(fst._fields(dict(fst._fields(spec))[3]))[2]
    texts = ["ﬁ ﬁｉ１ ①ａｂ", "a\u3000b\tc\u200bd", "  ab   cd  ", "e\u0301 o\u0308\u0323", "㍿ ½ ｶﾞ 각", "\u00a0a", "", "   ", "\x01a\x7f"]
    for squeeze in (0, 1):
        path = unigram_model(tmp_path / f"n{squeeze}.model", PIECES, True, rules, squeeze)
        library, own = sentencepiece.SentencePieceProcessor(model_file=path), fst.Transducer(path)
        for text in texts:
            assert list(unpack(f"<{len(own.encode(text)) // 4}i", own.encode(text))) == library.encode(text), (text, squeeze)


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "a bc, " * 60_000, "x", "y"), (2, "z" * 100_000, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces string, ids string")
    for r in fst.digests(fst.encode(docs, MODEL), MODEL).collect():
        ids, text = brute(rows[r.doc_id - 1][1])
        assert (r.n_pieces, r.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())


def test_marks_of_all_kinds_and_few_kept_stretches():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), fst.Transducer(MODEL), random.Random(7)
    texts = [t for t in ODD if t] + ["\0", "\0a b\0", "a \0 b", "a ", " a", "a\n b", "a \n", "▁", "a▁b", "a▁ b", ""]
    texts += ["".join(rng.choice("ab the.,\n ▁\0é") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    expected = library.encode(texts)
    assert own.encode_all(texts).to_pylist() == expected
    own.kept.most = 200  # a few stretches: what was kept goes again and again
    for at in range(0, len(texts), 9):
        assert own.encode_all(texts[at : at + 9]).to_pylist() == expected[at : at + 9]
    assert own.encode_all([]).to_pylist() == []
    assert [own.shortest_path(s) for s in ("", "▁the", "▁theft")] == [[], *library.encode(["the", "theft"])]


def test_stretches_of_one_beginning_share_its_places():
    class Counting(dict):
        asked = 0

        def get(self, key):
            Counting.asked += 1
            return super().get(key)

    own = fst.Transducer(MODEL)
    own.states = Counting(own.states)
    words = [f"internationalisation{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]
    ids = own.encode(" ".join(words))
    assert list(unpack(f"<{len(ids) // 4}i", ids)) == brute(" ".join(words))[0]
    assert Counting.asked < 30 * len(words)


def test_texts_over_several_portions():
    rows = [(i, f"row {i} " + "of words, " * (i % 7), "x") for i in range(60)] + [(60, None, "x"), (61, "", "x")]
    own = fst.transducer(MODEL)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] or "" for r in rows])], names=["doc_id", "text"])
    dealt = list(fst.of_size(iter([batch]), 50))
    assert len(dealt) > 20 and [i for b in dealt for i in b.column(0).to_pylist()] == list(range(62))
    assert [i for b in dealt for i in own.encode_all(b.column(1).to_pylist()).to_pylist()] == [brute(t)[0] for _, t, _ in rows]
