import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import library_tokens, packed, queries
from tests.llm.test_bpe import _texts, split_rows
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_pack_round_trip_and_random_access(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << width) - 1), min_size=1, max_size=70)), np.uint32)
    raw = packed.pack(ids, width)
    first = data.draw(st.integers(0, len(ids) - 1))
    assert packed.unpack(raw, width, 0, len(ids)).tolist() == ids.tolist()
    assert packed.unpack(raw, width, first, len(ids) - first).tolist() == ids[first:].tolist()


def test_shard_reads_any_range(tmp_path, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK", 64)
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 200, 40)
    ids = rng.integers(0, 49408, sizes.sum()).astype(np.uint32)
    w = packed.ShardWriter(f"file://{tmp_path}/a/x.ids", packed.width_for(49408))
    half = int(sizes[:17].sum())
    w.add(list(range(17)), ids[:half], sizes[:17])
    w.add([None, *range(18, 40)], ids[half:], sizes[17:])
    w.close()
    s = packed.Shard(f"file://{tmp_path}/a/x.ids")
    assert s.docs.tolist() == [*range(17), packed.NULL_ID, *range(18, 40)]
    for a, n in ((0, len(ids)), (63, 2), (64, 64), (100, 1), (5, 0), (len(ids) - 3, 3)):
        assert s.read(a, n).tolist() == ids[a : a + n].tolist()
    assert [b - a for a, b, _ in s.documents(run=500)] and sum(len(x) for *_, x in s.documents(run=500)) == len(ids)


def test_pieces_equal_the_library():
    assert library_tokens.drops_space(PATH) and not library_tokens.drops_space(public_tokenizers.path("byte_bpe_50k.json"))
    for path in (PATH, public_tokenizers.path("byte_bpe_50k.json")):
        library = Tokenizer.from_file(path)
        want = [library.encode(t, add_special_tokens=False).ids for t in _texts()]
        assert split_rows(library_tokens.LibraryEncoder(path), _texts()) == want


@pytest.mark.parametrize("empty", [False, True])
def test_query_equals_brute_force(spark, tmp_path, empty):
    texts = [] if empty else [*_texts()[:50], None]
    rows = [(1000 - i * 3, t, "x") for i, t in enumerate(texts)] + ([] if empty else [(7, "twice", "y"), (7, "twice", "y")])
    spark.createDataFrame(rows, "doc_id long, text string, start string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_packed_ids(spark, str(tmp_path)).orderBy("start").collect()
    library, want, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
