import random
import unicodedata

import pytest
from conftest import rows

from warpline.llm import leaks as L

WORDS = [a + b for a in ("bar", "cor", "den", "fal", "gri", "hom", "jul", "kem", "lor", "mun") for b in ("ast", "elo", "ine", "oth", "usk", "yde", "arn", "ick")]


def passage(seed, n=40):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


ITEM = passage(1)
OTHER = passage(2)
SUMS = "161+133 _294\n856+447 _1303\n101+441 _542\n425+698 _1123\n692+382 _1074"
JA = "山あいの郵便局が閉まってから、祖母は驢馬に乗って峠を三つ越え、市場まで手紙を届けた。"


def changed(words, every=10):
    return [w if i % every else "really" for i, w in enumerate(words, 1)]


FOUND = {
    "whole": " ".join(ITEM), "upper": " ".join(ITEM).upper(), "half": " ".join(OTHER[:9] + ITEM[10:31] + OTHER[9:]), "changed": " ".join(changed(ITEM)),
    "lines": "\n> ".join(ITEM), "markup": " ".join(f"<b>{w}</b>" if i % 4 == 0 else w for i, w in enumerate(ITEM)), "numbered": "\n".join(f"[{i}] {' '.join(ITEM[i * 8 : i * 8 + 8])}" for i in range(5)),
    "accents": unicodedata.normalize("NFD", " ".join(ITEM).replace("a", "á")), "pieces": " ".join(ITEM[:14]) + " " + " ".join(OTHER[:20]) + " " + " ".join(ITEM[14:]), "soft": " ".join(w[:2] + "­" + w[2:] for w in ITEM),
}
NOT = {"short": " ".join(ITEM[:7] + OTHER), "shuffled": " ".join(random.Random(4).sample(ITEM, len(ITEM))), "far": " ".join(OTHER), "empty": "", "blank": " \n"}


def held(texts, items):
    index = L.Items(items)
    return {(d, index.ids[i]) for d, i in L.held_items([L.tokens(t) for t in texts], index)}


@pytest.mark.parametrize("name", FOUND)
def test_found(name):
    assert held([FOUND[name]], [(7, " ".join(ITEM))]) == {(0, 7)}


@pytest.mark.parametrize("name", NOT)
def test_not_found(name):
    assert held([NOT[name]], [(7, " ".join(ITEM))]) == set()


def test_numbers():
    masked = " ".join(ITEM[:20] + ["N", "crowns"] + ITEM[20:])
    assert held([masked.replace("N", "17")], [(1, masked)]) == {(0, 1)}
    assert held(["7\t" + SUMS.replace("\n", "\n8\t")], [(2, SUMS)]) == {(0, 2)}
    assert held([SUMS.translate(str.maketrans("123456789", "912345678"))], [(2, SUMS)]) == set()


def test_signs():
    assert held(["これは" + JA[:30] + "別の話です。"], [(3, JA)]) == {(0, 3)}
    assert held([JA[:6] + "別の話です。"], [(3, JA)]) == set()


def test_tiles_against_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        a = [rng.randrange(4) for _ in range(14)]
        b = [rng.randrange(4) for _ in range(20)]
        hits = [(j, i) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        if not hits:
            continue
        import numpy as np

        got = L.tiles(np.array([h[0] for h in hits]), np.array([h[1] for h in hits]), 3, len(a))
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in got)
        used_a = [x for i, _, n in got for x in range(i, i + n)]
        used_b = [x for _, j, n in got for x in range(j, j + n)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        # the first tile is a longest common run; nothing of a seed's length is left
        longest = max(n for n in range(3, 15) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n])
        assert got[0][2] == longest
        assert not [1 for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3] and not set(range(i, i + 3)) & set(used_a) and not set(range(j, j + 3)) & set(used_b)]


def test_query(spark, monkeypatch):
    docs = [(i, t, "x", 1) for i, t in enumerate([*FOUND.values(), *NOT.values(), None, "filler " * 50_000 + " ".join(ITEM)])]
    docs.append(docs[0])
    d = spark.createDataFrame(docs, "doc_id bigint, text string, t string, item_id int")
    items = spark.createDataFrame([(7, " ".join(ITEM), "x"), (7, " ".join(ITEM), "x"), (8, " ".join(ITEM), "x"), (9, None, ""), (10, "", "")], "item_id bigint, text string, doc_id string")
    want = {(i, k) for i in [*range(len(FOUND)), len(FOUND) + len(NOT) + 1] for k in (7, 8)}
    assert rows(L.leaks(d, items)) == want
    monkeypatch.setattr(L, "ITEMS_AT_ONCE", 1)
    monkeypatch.setattr(L, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(L, "TOKENS_AT_ONCE", 50)
    assert rows(L.leaks(d, items)) == want
    assert L.leaks(d.limit(0), items).count() == 0 and L.leaks(d, items.limit(0)).count() == 0


def random_corpus(seed):
    """Items that share phrases, and texts that quote them whole, in part, changed, repeated, moved, or not."""
    rng = random.Random(seed)
    shared = [passage(1000 + k, 6) for k in range(4)]
    items = []
    for k in range(40):
        words = passage(seed * 100 + k, rng.choice([3, 8, 20, 40, 90]))
        at = rng.randrange(len(words))
        items.append((k, " ".join(words[:at] + rng.choice(shared) + words[at:])))
    texts = []
    for _ in range(60):
        words = passage(rng.random(), 80)
        for _ in range(rng.randrange(4)):
            item = items[rng.randrange(40)][1].split()
            a, n = rng.randrange(len(item)), rng.choice([3, 6, 12, 30, 99])
            part = [w if rng.random() > 0.12 else "other" for w in item[a : a + n]] * rng.choice([1, 1, 3])
            at = rng.randrange(len(words))
            words[at:at] = part + rng.choice(shared) * rng.randrange(3)
        texts.append(" ".join(words))
    return texts, items


@pytest.mark.parametrize("seed", range(3))
def test_bounds_and_limits_lose_nothing_against_brute_force(seed, monkeypatch):
    texts, items = random_corpus(seed)
    got = held(texts, items)
    monkeypatch.setattr(L, "HITS_AT_ONCE", 50)
    assert held(texts, items) == got and len(got) > 20
    monkeypatch.setattr(L, "most_covered", lambda group, place, seed: L.np.full(len(set(group.tolist())), 10**9))
    monkeypatch.setattr(L, "_possible", lambda items, docs, *rest: tuple(L.np.array(c) for c in zip(*[(d, k) for d in sorted(set(docs.tolist())) for k in range(len(items.ids))], strict=True)))
    assert held(texts, items) == got


def test_equal_matches_are_capped_without_a_loss():
    rng = L.np.random.default_rng(1)
    for _ in range(60):
        item = rng.integers(2, 6, 14)
        doc = rng.integers(2, 6, 400)
        pairs = [(b, a) for a in range(12) for b in range(398) if (item[a : a + 3] == doc[b : b + 3]).all()]
        if not pairs:
            continue
        d, i = L.np.array(pairs).T
        got = L.tiles(d, i, 3, 14)
        assert sorted(got) == sorted(uncapped(d, i, 3, 14))


def uncapped(d, i, seed, length):
    """Greedy string tiling by its definition."""
    pairs, out, used_item, used_doc = set(zip(i.tolist(), d.tolist(), strict=True)), [], set(), set()
    single = {(a + k, b + k) for a, b in pairs for k in range(seed)}
    while True:
        best = None
        for a, b in sorted(single):
            n = 0
            while (a + n, b + n) in single and a + n not in used_item and b + n not in used_doc:
                n += 1
            if n >= seed and (best is None or n > best[2]):
                best = (a, b, n)
        if best is None:
            return out
        out.append(best)
        used_item |= set(range(best[0], best[0] + best[2]))
        used_doc |= set(range(best[1], best[1] + best[2]))


def test_a_phrase_of_many_items_repeated_in_a_text_ends_soon():
    import time

    phrase = ["all", "rights", "reserved"]
    items = [(k, " ".join(passage(k, 15) + phrase + passage(k + 10**6, 15))) for k in range(5000)]
    index = L.Items(items)
    start = time.perf_counter()
    texts = [phrase * 4000, phrase * 2000 + items[77][1].split() + phrase * 2000]
    assert [(d, index.ids[i]) for d, i in L.held_items(texts, index)] == [(1, 77)]
    assert time.perf_counter() - start < 20
