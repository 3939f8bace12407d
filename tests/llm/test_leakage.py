"""Leaked passages: planted, near misses, disguises; seeds against brute force."""

import random

import numpy as np
import pytest

from tidemark.llm.leakage import SEED, Matcher, SuffixAutomaton, holds_any_stretch, leaked_items, words_of

RNG = random.Random(11)
VOCABULARY = [f"{a}{b}" for a in ("ba", "ke", "mo", "tri", "su", "pla") for b in ("ld", "nner", "sk", "tt", "zing", "ve", "rom")]
PASSAGES = [" ".join(RNG.choices(VOCABULARY, k=80)) for _ in range(6)]
ITEMS = [(i, p) for i, p in enumerate(PASSAGES)]
NOISE = "the desk looked at the ledger again and found nothing odd in it today".split()


def hidden(words):
    return " ".join([*NOISE, *words, *NOISE])


def edited(words, one_in):
    out = []
    for k, w in enumerate(words):
        kind = k % (3 * one_in)
        if kind == 2:
            out.append("changed")
        elif kind == one_in + 2:
            continue
        elif kind == 2 * one_in + 2:
            out += ["added", w]
        else:
            out.append(w)
    return out


@pytest.fixture(scope="module")
def matcher():
    return Matcher(ITEMS)


def test_whole_part_and_edited(matcher):
    w = PASSAGES[2].split()
    assert matcher.leaked(hidden(w)) == [2]
    assert matcher.leaked(hidden(w[20:52])) == [2]
    assert matcher.leaked(hidden(edited(w, 8))) == [2]
    assert matcher.leaked(hidden(w[:35]) + " " + hidden(PASSAGES[4].split()[10:45])) == [2, 4]


def test_near_misses(matcher):
    w = PASSAGES[3].split()
    assert matcher.leaked(hidden(w[10:30])) == []
    assert matcher.leaked(hidden(edited(w[:60], 3))) == []
    assert matcher.leaked(hidden(w[:20]) + " " + hidden(w[40:60])) == []
    assert matcher.leaked("") == matcher.leaked(" ".join(RNG.choices(VOCABULARY, k=500))) == []


def test_disguises(matcher):
    w = PASSAGES[0].split()[:40]
    assert matcher.leaked("<p>" + "<br/> ".join(w).upper() + "</p>") == [0]
    assert matcher.leaked(hidden([f"**{x}**" if i % 3 else f"<i>{x}</i>," for i, x in enumerate(w)])) == [0]
    assert matcher.leaked("&nbsp;".join(x[:2] + "­" + x[2:] for x in w)) == [0]
    assert matcher.leaked(hidden([x + "[3]" if i % 7 == 0 else x for i, x in enumerate(w)])) == [0]
    assert matcher.leaked("\n".join("".join(chr(ord(c) + 0xFEE0) for c in x) for x in w)) == [0]
    assert matcher.leaked(" ".join(x[:2] + "-\n" + x[2:] if i % 5 == 0 else x for i, x in enumerate(w))) == [0]


def test_words():
    assert words_of("The <b>Kiln’s</b> 17.4 coﬀee–price,[2] [see](http://x) short-\ndated &amp; café") == ["the", "kilns", "174", "coffeeprice", "see", "shortdated", "cafe"]


def test_seeds_are_all_common_runs():
    rng = np.random.default_rng(4)
    passages = [rng.integers(0, 4, 60).tolist() for _ in range(5)] + [[], [1], [1, 2]]
    passages.append(passages[0][:30])
    text = rng.integers(-1, 4, 200).tolist()
    at, item, end = SuffixAutomaton(passages).seeds(text)
    wanted = {(i, k, j) for i in range(SEED - 1, len(text)) if min(text[i - SEED + 1 : i + 1]) >= 0 for k, p in enumerate(passages) for j in range(SEED - 1, len(p)) if p[j - SEED + 1 : j + 1] == text[i - SEED + 1 : i + 1]}
    assert set(zip(at.tolist(), item.tolist(), end.tolist())) == wanted


def test_stretches():
    same, other = np.arange(40), np.arange(100, 140)
    assert holds_any_stretch(same, same) and not holds_any_stretch(same, other)
    assert not holds_any_stretch(same[:29], same[:29])
    five, six = same[:30].copy(), same[:31].copy()
    five[3:28:5] = -1
    six[3:29:5] = -1
    assert holds_any_stretch(same[:30], five) and not holds_any_stretch(same[:31], six)


def test_table(spark):
    docs = [(1, hidden(PASSAGES[1].split()), 5), (1, hidden(PASSAGES[1].split()), 5), (2, None, 5), (3, "", 5), (4, "word " * 50_000 + PASSAGES[5], 5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, (9, None), (10, ""), ITEMS[0]], "item_id bigint, passage string")
    for block in (1_000_000, 100):
        got = leaked_items(df, items, "doc_id", "text", "item_id", "passage", block_words=block)
        assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 1), (4, 5)]
    assert leaked_items(df.limit(0), items, "doc_id", "text", "item_id", "passage").count() == 0
    assert leaked_items(df, items.limit(0), "doc_id", "text", "item_id", "passage").count() == 0


def test_stretch_beside_a_more_edited_copy():
    p = [f"w{i}" for i in range(100)]
    near = [f"x{i}" if i % 4 == 3 else w for i, w in enumerate(p)]
    m = Matcher([(7, " ".join(p))])
    assert m.leaked(" ".join(near)) == [] and m.leaked(" ".join(p[40:75])) == [7]
    assert m.leaked(" ".join([*near, "one", "two", "three", *p[40:75]])) == [7]
    assert m.leaked(" ".join([*p[40:75], "one", "two", "three", *near])) == [7]
    assert m.leaked(" ".join([*near, "one", "two", "three", *p[40:69]])) == []


def within(passage, text, stretch, one_in):
    """Brute force: the edit distance of every part of the passage, its ends kept, to its nearest part of the text."""
    for s in range(len(passage) - stretch + 1):
        row = [99] + [0 if x == passage[s] else 99 for x in text]
        for size, w in enumerate(passage[s + 1 :], 2):
            new = [row[0] + 1]
            for j, x in enumerate(text, 1):
                if size >= stretch and w == x and row[j - 1] * one_in <= size:
                    return True
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
            row = new
    return False


def test_any_stretch_is_the_brute_force():
    rng = np.random.default_rng(8)
    seen = set()
    for k in range(150):
        passage = rng.integers(0, 30, 26)
        text = np.concatenate([np.where(rng.random(26) < rng.uniform(0, 0.5), rng.integers(0, 30, 26), passage), rng.integers(0, 30, 4), passage[: rng.integers(0, 9)]])
        text = np.delete(text, rng.integers(0, len(text), rng.integers(0, 3)))
        wanted = within(passage.tolist(), text.tolist(), 8, 4)
        assert holds_any_stretch(passage, text, 8, 4) == wanted
        seen.add(wanted)
    assert seen == {True, False}


def test_matcher_is_the_brute_force():
    """Seeds, buckets, windows and check together, on copies of 30 to 60 words around the limit of edits."""
    rng = np.random.default_rng(21)
    passage = [f"p{i}" for i in rng.integers(0, 60, 75)]
    m, seen = Matcher([(1, " ".join(passage))]), []
    for k in range(60):
        size = int(rng.integers(30, 61))
        at = int(rng.integers(0, len(passage) - size + 1))
        copy, rate = [], rng.uniform(0.12, 0.4)
        for w in passage[at : at + size]:
            kind = rng.integers(0, 3) if rng.random() < rate else 3
            copy += {0: ["changed"], 1: [], 2: ["added", w], 3: [w]}[int(kind)]
        noise = [f"p{i}" for i in rng.integers(0, 60, 12)]
        text = [*noise, *copy, *noise[:5]]
        if k % 2:  # a more heavily edited copy beside it
            text = [*(w if i % 4 else "other" for i, w in enumerate(passage)), "and", *text]
        wanted = within(passage, text, 30, 6)
        assert m.leaked(" ".join(text)) == [1] * wanted, (k, text)
        seen.append(wanted)
    assert 10 < sum(seen) < 50


def test_deletions_that_move_the_diagonal():
    passage = [f"w{i}" for i in range(54)]
    text = [w for i, w in enumerate(passage) if i % 6 != 3]
    assert Matcher([(1, " ".join(passage))]).leaked(" ".join(text)) == [1]
