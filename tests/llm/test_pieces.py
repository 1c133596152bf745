"""SentencePiece encoding against the library, text by text."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpus_engine.llm import piece_encoding as P
from corpus_engine.llm import queries
from tests.conftest import SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ROWS = [
    (1, "", "x"), (2, None, None), (3, " ", "x"), (4, "  ", "x"), (5, "a  b", "x"), (6, "\n", "x"), (7, "a\n\n b\r\n c ", "x"),
    (8, "▁a ▁▁b▁", "x"), (9, "x\x00y", "x"), (10, "日本語😀 é ﬁ", "x"), (11, "x" * 30_000, "x"), (1, "", "x"), (None, "a b", None),
    (12, "\n \n", "x"), (13, "a \n", "x"), (14, " \n a", "x"), (15, "<s> </s> <unk> <0x0A>", "x"), (16, "uno dos " * 5_000, "x"),
    (17, " " * 40 + "z", "x"), (None, None, None), (5, "a  b", "x"),
]


def expected(rows):
    return sorted(((str(i), str(n), tuple(LIBRARY.encode(t or "")), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t, n in rows))


def found(frame, **options):
    out = P.decode(P.encode(frame, PATH, **options), PATH)
    return sorted((str(r.doc_id), str(r["n"]), tuple(r._ids), r._text) for r in out.collect())


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20, "bucket_bytes": 1 << 16}, {"settled": True, "block_bytes": 3_000}])
def test_odd_texts_as_the_library(spark, options):
    # Columns with the names that the operator uses itself.
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, n string").withColumn("block", F.lit(1)).withColumn("row", F.lit("r"))
    assert found(frame, **options) == expected(ROWS)
    assert P.encode(frame, PATH, **options).columns == ["doc_id", "n", "block", "row", "_ids"]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, n string")
    assert found(frame) == [] and P.encode(frame, PATH).columns == ["doc_id", "n", "_ids"]


def test_windows_of_any_size(spark, monkeypatch, documents):
    whole = documents.select("doc_id", "text", F.col("lang").alias("n")).limit(60)
    rows = [tuple(r) for r in whole.collect()]
    monkeypatch.setattr(P, "WINDOW", 5)
    assert found(spark.createDataFrame(rows, whole.schema), block_bytes=9_000) == expected(rows)


def test_packing_round_trip():
    import numpy as np

    draw = np.random.default_rng(1)
    runs = [np.unique(draw.integers(0, 10**k, size=draw.integers(1, 40))) for k in (1, 3, 6, 8) for _ in range(20)]
    count = np.array([len(r) for r in runs])
    packed = P.packed(np.concatenate(runs).astype(np.int32), np.concatenate([[0], np.cumsum(count)]))
    back = [(v, r) for values, which in P.unpacked(packed, count) for v, r in zip(values, which)]
    assert back == [(v, i) for i, r in enumerate(runs) for v in r]
    for values in ([], [0], [255, 256], [70_000, 3]):
        assert P.spread(P.squeezed(np.array(values, dtype=np.int64))).tolist() == values


def test_query_digests(spark, texts):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_pieces(spark, SMALL).collect()}
    want = {}
    for i, t in texts.items():
        ids = LIBRARY.encode(t or "")
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
    assert got == want


def test_a_model_whose_pieces_could_cross_is_refused(tmp_path, monkeypatch):
    class Odd:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "▁of▁the"

    monkeypatch.setattr(P, "processor", lambda model: Odd())
    (tmp_path / "m").write_bytes(b"x")
    with pytest.raises(ValueError, match="cross"):
        P.read_model(str(tmp_path / "m"))
