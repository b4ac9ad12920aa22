"""Piece encoding against the library's own, and spans against the text."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece

from cellgrid.llm import pieces, queries
from cellgrid.llm.tokens import vocabulary

PARTS = ["a", "b", " ", "  ", "\n", "é", "▁", "ﬁ", "　", "😀", "힣", "the", "tion", "\t", "\x00", "x" * 70, " " * 40, "</s>", "<0x0A>", "é"]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(vocabulary(pieces.MODEL))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(library, docs):
    out = Counter()
    for doc, text in docs:
        ids = library.encode(text or "", add_eos=True)
        out[doc, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), len((text or "").encode())] += 1
    return out


def test_query(spark, encoder, odd_rows, tmp_path):
    docs = [*odd_rows, (2**60 + 1, " lead​ and trail ", "en", "s", 0, "v", 1), (2**60 + 3, "x " * 300_000, "en", "s", 0, "v", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, ids string, e int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_sentencepiece(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == wanted(encoder.library, [d[:2] for d in docs])


def test_query_on_no_documents(spark, empty, tmp_path):
    empty.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_sentencepiece(spark, str(tmp_path)).count() == 0


def check_spans(encoder, text):
    ids, begins, ends = encoder.encode(text)
    want = encoder.library.encode(text, return_type="proto").pieces
    raw = text.encode()
    assert ids.tolist() == [p.id for p in want]
    assert b"".join(raw[a:b] for a, b in zip(begins, ends, strict=True)) == raw
    for p, a, b in zip(want, begins, ends, strict=True):
        if not p.piece.startswith("<0x"):
            assert raw[a:b].decode() == p.surface


def test_spans_tile_the_text(encoder, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(0, 40))) for _ in range(600)]
    for t in texts:
        check_spans(encoder, t)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 25)
    for t in texts:
        check_spans(encoder, t)


class Counting:
    """A library that counts the characters it is given."""

    def __init__(self, inner):
        self.inner, self.chars = inner, 0

    def encode(self, text, **kind):
        self.chars += len(text)
        return self.inner.encode(text, **kind)


def test_words_that_come_again_are_encoded_once(monkeypatch):
    encoder = pieces.Encoder(vocabulary(pieces.MODEL))
    counting = Counting(encoder.inner)
    monkeypatch.setattr(encoder, "inner", counting)
    text = "the tiger\nand the  naïve 😀 tiger   " * 500
    check_spans(encoder, text)
    assert counting.chars < 100
    check_spans(encoder, text[:-1])
    assert counting.chars < 100


@pytest.mark.parametrize("kept", [0, 40, 1 << 21])
def test_words_as_in_the_whole_text(monkeypatch, kept):
    encoder = pieces.Encoder(vocabulary(pieces.MODEL))
    monkeypatch.setattr(pieces, "KEPT_CHARS", kept)
    rng = random.Random(3)
    parts = [p for p in PARTS if p != "▁"] + ["ing", "er", "\r\n", "日本", "\ue000"]
    for _ in range(1500):
        check_spans(encoder, "".join(rng.choices(parts, k=rng.randrange(0, 30))))


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_as_in_the_library(encoder, monkeypatch, rule, squeeze):
    """Longest keys of compiled maps that the library brings, with their alignment."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    spec = dict(pieces.proto_fields(library.serialized_normalizer_spec()))
    monkeypatch.setattr(encoder, "map", pieces.CharacterMap(spec[2]))
    monkeypatch.setattr(encoder, "squeeze", squeeze)
    rng = random.Random(4)
    parts = ["a", "B", " ", "  ", "é", "é", "ﬁ", "　", "㍿", "①", "ｶﾞ", "​", "가", "각", "́", "q̣̇", "\n", "ß", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 20)))
        norm, begins, ends = encoder.normalised(text)
        want, offsets = library.Normalize(text, with_offsets=True)
        assert (norm, begins.tolist()) == (want, offsets[:-1])
        assert all(a <= b for a, b in zip(begins, ends, strict=True))
    assert encoder.normalised("㍿x")[2].tolist() == [0, 1, 1, 1, 1, 2]
