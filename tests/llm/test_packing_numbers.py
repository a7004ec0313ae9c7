"""Pre-tokens are looked up once; those forgotten are encoded again with the same ids."""

from freshet.llm import packing
from freshet.llm.queries import tokenizer_path


def test_pre_tokens_are_numbered_by_first_sight_and_forgotten_whole(monkeypatch):
    coder = packing.WordEncoder(tokenizer_path())
    texts = ["the cat, the hat", "12 CATS it's", ""]
    for limit, kept in ((100, ["the", "cat", ",", "hat", "1", "2", "cats", "it", "'s"]), (3, [])):
        monkeypatch.setattr(packing, "CACHE", limit)
        coder = packing.WordEncoder(tokenizer_path())
        for _ in range(2):
            assert [ids.tolist() for ids in coder.encode(texts)] == [coder.whole(t) for t in texts]
            assert list(coder.rows) == kept and not coder.rows.new
