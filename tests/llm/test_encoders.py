import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessaro.llm import toxicity_knn, word_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCéüñß0123456789"
    marks = ["", "", ".", ",", "!?", "...", "###", "'s", "<|", "-x", "—", " y"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 10))) + rng.choice(marks) for _ in range(300)]
    texts = [rng.choice(["", " ", "\n", "\t\t"]).join(["", *(rng.choice(words) + rng.choice([" ", "  ", "\n", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))]) for _ in range(80)]
    return [*texts, "", " ", "<|endoftext|> a<|startoftext|>b", "日本語 テスト。", "x" * 500, "\x1c\x1d a", "İstanbul ΑΣ"]


@pytest.mark.parametrize("lot, kept", [(1 << 22, 600_000), (150, 40)])
def test_ids_are_those_of_the_library(monkeypatch, lot, kept):
    monkeypatch.setattr(word_ids, "LOT", lot)
    monkeypatch.setattr(word_ids, "KEPT", kept)
    texts = odd_texts()
    with open(PATH, encoding="utf-8") as f:
        own = word_ids.WordEncoder(f.read())
    whole = Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from what is known
        got = own.encode([t.encode() for t in texts])
        for t, raw in zip(texts, got, strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert own.encode([]) == []


def test_copies_of_an_example_count_one_by_one():
    rng = random.Random(2)
    kinds = [{rng.randrange(30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))} for _ in range(25)]
    examples = [(dict(rng.choice(kinds)), rng.randrange(2), 1000 + k) for k in range(700)] + [({}, 1, 5)]
    index = toxicity_knn.BlockMaxIndex.build(np.array([1 + rng.random() for _ in range(30)]), examples)
    assert len(index.first) - 1 == len({tuple(sorted(c.items())) for c, _, _ in examples if c}) and len(index.label) == 700
    by_id = {d: c for c, _, d in examples}
    dense = np.zeros((700, 30))
    for i, d in enumerate(index.doc_id.tolist()):
        t, w = index.vector(by_id[d])
        dense[i, t] = w
    for c in kinds:
        t, q = index.vector(c)
        cosine = dense[:, t] @ q
        for without in (-1, int(np.argmax(cosine))):
            at, found = index.nearest(c, 16, without)
            left = np.delete(cosine, without) if without >= 0 else cosine
            left = np.sort(left[left > 1e-12])[::-1][:16]
            assert without not in at and len(set(at.tolist())) == len(at) and np.allclose(found, left)
            assert np.allclose(cosine[at], found)


def test_density_tells_texts_with_the_same_words_apart():
    lookup = toxicity_knn.Lookup({b"bad": 0})
    short, long = (toxicity_knn.term_counts(b"bad " + b"fine " * n, lookup) for n in (3, 3000))
    assert short[0] == long[0] == 1 and short[1] < long[1]
    assert toxicity_knn.term_counts(b"fine words", lookup) == {} == toxicity_knn.term_counts(b"", lookup)
