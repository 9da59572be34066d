import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gavelwork.llm import packing, token_files, tokens, words
from tests.llm.helpers import ROWS, TOKENIZER, empty, hard

WHOLE = Tokenizer.from_file(TOKENIZER)
PARTS = [
    "ñö", "ŷŧ", "µ", "'s", "'T", "'Ll", "''s", " ", "\t", "\n", "\x1c", "\x85", "\xa0", "é", "É", "İ", "ß", "Σ", "ς", "́", "a", "B", "9",
    "½", "<|endoftext|>", "<|", "|>", "日本", "Ⅷ", "٣", "!", "...", "​", " ", "\x00", "\x7f", "ſ", "ŀ", " ́", "👍🏽",
]


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_are_those_of_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, "", " x "]
    column = words.as_array(pa.array(texts, pa.string()))
    coder = tokens.encoder(TOKENIZER)
    assert coder.by_run
    for begin, end in words.steps(column, 5000):
        bounds, ids = coder.encode(column.slice(begin, end - begin))
        for i in range(end - begin):
            assert [*ids[bounds[i]:bounds[i + 1]], 2] == ids_of(texts[begin + i])


def test_perfect_hash_is_minimal_and_refuses_strangers():
    rng = np.random.default_rng(1)
    low = rng.choice(1 << 40, 5000, replace=False).astype(np.uint64)
    high = np.zeros(5000, np.uint64)
    table = token_files.PerfectHash.build(low[:4000], high[:4000])
    assert sorted(table.slots(low[:4000], high[:4000])) == list(range(4000))
    assert len(token_files.PerfectHash.build(low[:0], high[:0]).slots(low[:5], high[:5])) == 5
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(np.array([1, 1], np.uint64), np.zeros(2, np.uint64))


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_token_files_round_trip(spark, tmp_path, shard_ids):
    folder = str(tmp_path / "files")
    shards = token_files.write(hard(spark), folder, TOKENIZER, shard_ids=shard_ids)
    rows = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    assert shards.agg({"n_docs": "sum"}).first()[0] == len(ROWS)
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10]
    at, left = 0, {}
    for doc_id, text, *_ in ROWS:
        left.setdefault(doc_id, []).append(ids_of(text))
    for row in rows:
        ids = np.frombuffer(row["ids"], "<u4")
        assert row["start"] == at and row["n_tokens"] == len(ids) and row["ids_crc32"] == zlib.crc32(row["ids"])
        left[row["doc_id"]].remove(ids.tolist())
        at += len(ids)
    assert token_files.find(spark, folder, 10).tolist() == ids_of(ROWS[-1][1])
    assert token_files.find(spark, folder, 99) is None
    assert token_files.find(spark, folder, None) is not None


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path / "none")
    assert token_files.write(empty(spark), folder, TOKENIZER).count() == 0
    assert token_files.read(spark, folder).count() == 0
    assert packing.packed_digest(empty(spark), TOKENIZER).count() == 0


def test_windows_take_the_tightest():
    rng = random.Random(5)
    lengths = np.array(sorted((rng.randint(1, 64) for _ in range(500)), reverse=True))
    at, offset = packing.best_fit(lengths, 64)
    free = []
    for n, window, place in zip(lengths, at, offset, strict=True):
        fits = [f for f in free if f >= n]
        if window == len(free):
            assert not fits and place == 0
            free.append(64)
        assert not fits or free[window] == min(fits)
        assert place == 64 - free[window]
        free[window] -= n
    assert len(free) <= 1.05 * -(-lengths.sum() // 64) + 1


def test_packing_holds_every_id_once(spark, tmp_path):
    pieces = packing.stored_pieces(hard(spark), TOKENIZER)
    packed = packing.pack(pieces, group=20).toPandas()
    assert packed["length"].max() <= packing.WINDOW
    for _, rows in packed.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]]
        assert rows["length"].sum() <= packing.WINDOW
    left = [(i, ids_of(t)) for i, t, *_ in ROWS]
    packed["key"] = packed["doc_id"].astype(object).where(packed["doc_id"].notna(), None)
    for doc_id in {i for i, _ in left}:
        mine = packed[packed["key"].isna() if doc_id is None else packed["key"] == doc_id].sort_values("place")
        own = sorted(ids for i, ids in left if i == doc_id)
        got, one = [], []
        for row in mine.itertuples():
            assert row.start == len(one)
            one += np.frombuffer(row.ids, "<u4").tolist()
            if len(one) == row.doc_tokens:
                got.append(one)
                one = []
        assert sorted(got) == own and not one
    whole = packing.sequences(packing.pack(pieces)).collect()
    for row in whole:
        exact = row["length"] & (row["length"] - 1) == 0
        assert row["padded"] == (row["length"] if exact else packing.WINDOW) and len(row["ids"]) == 4 * row["padded"]
    assert {"sequence_id", "offset", "ids_crc32"} <= set(packing.packed_digest(hard(spark), TOKENIZER).columns)
