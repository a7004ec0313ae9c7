"""What a worker of the packing holds beside its table of known pre-tokens does not grow with the batch."""

from __future__ import annotations

import random
import tracemalloc

from freshet.llm import common, packing
from freshet.llm.queries import tokenizer_path


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))


def test_a_large_batch_is_encoded_in_small_slices(spark, monkeypatch):
    rng = random.Random(5)
    some = [words(rng, 100) for _ in range(40)]
    texts = [" ".join(rng.choices(some, k=2)) for _ in range(4500)]
    size = sum(map(len, texts))
    assert 6_000_000 < size < common.SLICE_CHARS
    encoder = packing.encoder(tokenizer_path())
    encoder.encode(some)
    peaks = []

    def here(df, fn, schema, slice_chars=common.SLICE_CHARS):
        step = max(1, len(texts) * slice_chars // size)
        tracemalloc.start()
        for start in range(0, len(texts), step):
            part = texts[start : start + step]
            assert len(fn({"doc_id": list(range(len(part))), "text": part})["length"]) == len(part)
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        return df

    monkeypatch.setattr(packing, "map_rows", here)
    packing.pieces(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), tokenizer_path())
    assert peaks[0] < 60


def test_the_table_grows_in_place_and_gives_the_same_ids():
    rng = random.Random(6)
    encoder = packing.WordEncoder(tokenizer_path())
    for _ in range(2):
        encoder.encode([words(rng, 1000)])
    flat = encoder.flat
    text = words(rng, 5)
    assert encoder.encode([text])[0].tolist() == encoder.whole(text)
    assert encoder.flat is flat
    many = [words(rng, 2000) for _ in range(5)] + ["", "caf\xe9 42 + <|x|>", "Ł\xf3dź"]
    for text, ids in zip(many, encoder.encode(many)):
        assert ids.tolist() == encoder.whole(text)


def test_a_full_table_forgets_only_the_newest(monkeypatch):
    rng = random.Random(7)
    encoder = packing.WordEncoder(tokenizer_path())
    first, second, third = (words(rng, 400) for _ in range(3))
    monkeypatch.setattr(packing, "CACHE", 500)
    for text in (first, second, f"{first} {third}", second):
        assert encoder.encode([text])[0].tolist() == encoder.whole(text)
        assert encoder.known == len(encoder.rows) <= 500
    assert encoder.sizes[: encoder.known].sum() == encoder.used


def test_a_worker_gives_back_the_room_of_its_batches(monkeypatch):
    class Frame:
        sparkSession = None

        def mapInArrow(self, fn, schema):
            return fn

    class Pool:
        calls = 0

        def release_unused(self):
            Pool.calls += 1

    monkeypatch.setattr(common, "ship", lambda spark: None)
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    run = common.map_rows(Frame(), lambda cols: {"n": [len(t) for t in cols["text"]]}, "n int")
    batches = [common.pa.record_batch({"text": ["a", "bb"]}), common.pa.record_batch({"text": ["ccc"]})]
    for given, found in ((batches, [1, 2, 3]), ([], [])):
        before = Pool.calls
        assert [n for b in run(iter(given)) for n in b.column(0).to_pylist()] == found
        assert Pool.calls == before + 1
