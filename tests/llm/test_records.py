import random
import struct
import zlib

import public_tokenizers as P
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freqloom.llm import records as R

from .helpers import ROWS, awkward, empty

FILE = P.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(FILE)  # as the library has it


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def packed(text):
    ids = ids_of(text)
    return struct.pack(f"<{len(ids)}H", *ids)


ODD = "aAzZ09'\"._-  \n\t\r\x0b\x0c\x1c\x1d\x85\u00a0\u3000\u200béÉçÇßİıſÀa\u0300\u0301\u0308ªº²½×÷ŉǅΣς日本🙂<|endoftext|>'s'LL'Re"
PLAIN = "aAzZ019'\"._-&  \n\t\r\x0céÉçÇßıſÀ×÷ŉŽ<|endoftext|>'s'LL'Re"


@pytest.mark.parametrize("pool", [ODD, PLAIN])
def test_texts_equal_the_library(pool):
    random.seed(1)
    tokens = R.TokenIds(TOK)
    assert tokens.by_words
    texts = ["<|startoftext|>a <|endoftext|> b<|EndOfText|>", " <|endoftext|>", "<|endoftext|"] + ["".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(4000)] + ["<|endoftext|>", "x" * 3000, "it's I'LL"]
    for batch in (texts, texts[:1], [""], ["", " a ", ""], []):
        assert tokens.encode_texts(pa.array([t.encode() for t in batch], pa.binary())) == [packed(t) for t in batch]
    assert len(tokens.encode_texts(pa.array([b"ok \xff\xfe", b""], pa.binary()))) == 2


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}}])
def test_other_tokenizers_are_left_to_the_library(change):
    import json

    tok = Tokenizer.from_str(json.dumps(json.loads(TOK.to_str()) | change))
    tokens, texts = R.TokenIds(tok), ["It's  a NICE day, isn't it?", "", "Élan 42 <|endoftext|>"]
    assert not tokens.by_words
    want = [struct.pack(f"<{len(x)}H", *x) for x in (tok.encode(t, add_special_tokens=False).ids for t in texts)]
    assert tokens.encode_texts(pa.array([t.encode() for t in texts], pa.binary())) == want


def test_neighbours_are_read_together(tmp_path, monkeypatch):
    parts = [bytes([k]) * (k + 1) for k in range(20)]
    (tmp_path / "a").write_bytes(b"".join(parts))
    (tmp_path / "b").write_bytes(b"".join(parts))
    at = [sum(map(len, parts[:k])) for k in range(20)]
    order = [*((f, k) for f in "ab" for k in range(20)), ("a", 7), ("a", 3), ("a", 4), ("b", 19)]
    places = [(f, at[k], k + 1) for f, k in order]
    for span in (4 << 20, 30, 1):
        monkeypatch.setattr(R, "SPAN", span)
        assert list(R.frames(pafs.LocalFileSystem(), str(tmp_path), places)) == [parts[k] for _, k in order]
    assert list(R.frames(pafs.LocalFileSystem(), str(tmp_path), [])) == []


def test_files_follow_the_rows():
    assert [R.file_count(n, 6) for n in (0, 999, 5_000, 10**6, 10**10)] == [1, 1, 5, 20, 200_000]
    assert R.file_count(300_000, 6) == 12 and R.file_count(300_000, 1000) == 300


def test_memo_turns(monkeypatch):
    monkeypatch.setattr(R, "MEMO", 3)
    tokens = R.TokenIds(TOK)
    for text in "one two three,four;five,one,six;two,one".split(",") * 2:
        assert tokens.encode_texts(pa.array([text.encode()], pa.binary())) == [packed(text)]
    assert len(tokens) <= 6 and tokens.old


def test_frames_detect_damage():
    data = R.frame(b"payload")
    assert R.unframe(data) == b"payload" and R.unframe(R.frame(b"")) == b""
    for k in range(len(data)):
        with pytest.raises(ValueError):
            R.unframe(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
    with pytest.raises(ValueError):
        R.unframe(data[:-1])


def test_round_trip_of_awkward_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/r"
    index = R.encode_to_records(awkward(spark), FILE, folder)
    got = sorted(R.read_records(index, folder).collect(), key=lambda r: r.place)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in ROWS), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.place == at
        at += r.n_tokens
        ids = struct.unpack(f"<{r.n_tokens}H", bytes(r.ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.n_tokens}I", *ids)) and ids[-1] == 1
    want = sorted(tuple(ids_of(t)) + (1,) for _, t, *_ in ROWS)
    assert sorted(struct.unpack(f"<{r.n_tokens}H", bytes(r.ids)) for r in got) == want
    some = R.read_records(index.where("doc_id >= 4").orderBy(F.desc("place")), folder, ids=False).collect()
    assert len(some) == sum((i or 0) >= 4 for i, *_ in ROWS) and all(r.ids is None for r in some)


def test_general_writer_and_damaged_file(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    rows = R.encode_words(awkward(spark).where("doc_id = 5"), FILE).coalesce(1)
    index = R.write_records(rows, folder)
    assert index.count() == 2
    name = index.first().file
    path = tmp_path / "w" / name
    data = bytearray(path.read_bytes())
    data[-6] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="bad data checksum"):
        R.read_records(index, folder).collect()


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    index = R.encode_to_records(empty(spark), FILE, folder)
    assert R.read_records(index, folder).count() == 0
    assert not [x for x in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(tmp_path / "e"))) if x.base_name.endswith(".rec")]
