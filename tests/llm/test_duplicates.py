"""Operators 5, 7 and 8 against brute force, and odd input."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from framequery.llm import components, decontaminate, passages, simhash
from framequery.llm.common import table
from tests.llm.fixtures import documents, odd

SF = "/root/testdata/sf0.001"


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_fingerprint(text, size=3):
    words, low = [], "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in " \t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints_and_components(spark):
    docs = table(spark, SF, "documents").collect()
    texts = {r["doc_id"]: r["text"] for r in docs}
    for d in (1, 5, 9):  # copies changed in one word, and texts without words
        texts[1000 + d] = texts[d].replace(texts[d].split()[3], "changed", 1)
    texts |= {2000: "", 2001: None, 2002: " \n"}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    links = [(a, b) for a, b in combinations(texts, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots_of(texts, links)
    got = simhash.simhash_components(documents(spark, list(texts.values()), list(texts))).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in texts}


def test_fingerprints_of_odd_input(spark):
    got = simhash.simhash_components(odd(spark)).collect()
    assert len(got) == 10
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (4, None)} == {4}
    assert simhash.simhash_components(odd(spark).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_balls_meet_within_the_radius(word, flips):
    other = word
    for b in flips:
        other ^= 1 << b
    ball = lambda w: {w ^ (m % (1 << 64)) for m in simhash.masks(64, 1)}
    assert bool(ball(word) & ball(other)) == (len(flips) <= 2)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("a b c dd Ä E".split()), max_size=30), st.integers(1, 6))
def test_shingles(words, size):
    low = [w.encode().lower() for w in words]
    want = [b" ".join(low[i : i + size]) for i in range(max(1, len(low) - size + 1))] if low else []
    assert simhash.shingles("  ".join(words), size) == want


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 40)]
    ring = [(900 + i, 900 + (i + 1) % 17) for i in range(17)]
    links = path + star + ring + [(7, 7), (3, 4), (4, 3)]
    rows = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    got = components.connected_components(rows).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["root"]].add(r["node"])
    want = [set(range(100, 161)), set(range(500, 540)), set(range(900, 917)), {3, 4}]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
    assert components.connected_components(rows.limit(0)).count() == 0


def test_near_duplicates_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{i}" for i in range(400)], 300)) for _ in range(6)]
    near = [b.replace(b.split()[150], "changed", 1) for b in base]
    other = " ".join(np.array(base[0].split())[::-1])
    docs = documents(spark, [*base, *near, base[0], other, None, ""], [*range(6), *range(10, 16), 20, 21, 22, 23])
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(6), 21, 22]
    assert kept.columns == docs.columns
    again = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in simhash.drop_near_duplicates(odd(spark)).collect())
    assert again == sorted([0, 3, 4, 5, 6, 7, -1])


def test_near_duplicates_by_fingerprints_and_by_sets(spark):
    """0 and 1 have one fingerprint but few shingles in common, 1 and 2 have the same
    set in other numbers: only both ways together make them one group."""
    words = lambda n, c: " ".join(f"{c}{i}" for i in range(n))
    often = " ".join(["one two three four five"] * 400)
    texts = [f"{often} {words(30, 'x')}", f"{often} {words(30, 'y')}", f"{' '.join(['one two three four five'] * 2)} {words(30, 'y')}", words(60, "z")]
    docs = documents(spark, texts)
    prints = [simhash.fingerprint_bits(t, 3, [42]) for t in texts]
    assert (prints[0] != prints[1]).sum() <= 2 and (prints[1] != prints[2]).sum() > 2
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs).collect()} == {1: 1, 2: 1}
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == [0, 3]


def test_crowded_near_duplicates_link(spark):
    rng = np.random.default_rng(6)
    words = list(dict.fromkeys(rng.choice([f"w{i}" for i in range(5000)], 300)))
    moved = [*words[1:], words[0]]  # the words of the first text in its order, all but one
    docs = documents(spark, [" ".join(w) for w in (words[::-1], words, moved)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs).collect()}
    assert got == {1: 1, 2: 1}


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    draw = lambda n: list(rng.choice([f"w{i}" for i in range(3000)], n))
    line, texts = draw(40), []
    for k in range(24):
        base = draw(int(rng.integers(60, 300)))
        new = int(len(base) * rng.uniform(0.05, 0.3))
        texts += [base, base + draw(new), base[: len(base) - new // 2] + draw(new // 2), line + base[: 20 + k], line + draw(6)]
        texts.append([w if rng.random() > 0.02 else "other" for w in base])
    order = rng.permutation(len(texts)).tolist()
    sets = {d: set(simhash.shingles(" ".join(texts[i]), 5)) for d, i in enumerate(order)}
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots_of(sets, links)
    linked = {d for pair in links for d in pair}
    docs = documents(spark, [" ".join(texts[i]) for i in order])
    for block in (1024, 3):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs, block=block).collect()}
        assert got == {d: want[d] for d in linked}


def test_benchmark_copies_against_ngrams(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    bench = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    word = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    want = {(d, i) for d, t in docs.items() for i, b in bench.items() if f" {' '.join(word(b))} " in f" {' '.join(word(t))} "}
    got = decontaminate.query(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["exact"] for r in got)


QUESTION = "Alice bought 12 apples for 3 dollars each and then sold all of the 12 apples to a friend called Robert at the market near the old town hall. How much did she earn?"


def test_questions_asked_again(spark):
    again = "text before, Maria bought 7 apples for 5 dollars each and then sold all of the 7 apples to a friend called Peter at the market near the old town hall. How much did she earn? text after"
    clash = again.replace("the 7 apples", "the 9 apples")
    short = "3 4 and 5 more"
    bench = spark.createDataFrame([(1, QUESTION), (2, "so short"), (3, None), (None, "x y z a b c"), (4, "1 2 3 4 5 6 7 8 9 10 11"), (5, short), (6, "yes")], "item_id long, text string")
    texts = [QUESTION.upper(), again, clash, "a clean text about apples and the market near the old town hall", None, "yes, so short one, here"]
    texts += ["look: 1 2 3 4 5 6 7 8 9 10 11", "look: 31 32 33 34 35 36 37 38 39 40 41", "it is 3 4 and 5 more of it", "it is 8 9 and 7 more of it"]
    found = decontaminate.contamination(documents(spark, texts), bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in found}
    assert got[1, 1] is False
    assert got[2, 1] is False
    assert not {3, 4, 5, 7} & {d for d, _ in got}
    assert got[6, 4] is True
    assert got[8, 5] is True
    assert got.keys() == {(0, 1), (1, 1), (2, 1), (6, 4), (8, 5)} | ({(9, 5)} & got.keys())
    matched = {(r["doc_id"], r["item_id"]): r["matched_windows"] for r in found}
    assert matched[2, 1] < matched[1, 1]


def test_one_number_changed_in_a_copy(spark):
    copy = QUESTION.replace("the 12 apples", "the 19 apples")
    got = decontaminate.contamination(documents(spark, [copy]), spark.createDataFrame([(1, QUESTION)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(0, 1)]


def plain_tokens(text):
    """Words of ASCII prose without units: (kind, word)."""
    out, before = [], "."
    for m in re.finditer(r"[0-9]+|[A-Za-z]+", text):
        w, lead = m[0], text[m.start() - 2 : m.start()]
        number = w.isdigit() or w.lower() in decontaminate.NUMBER_WORDS.split()
        name = w[0].isupper() and w[1:2].islower() and len(lead) == 2 and lead[1] == " " and (lead[0].isalnum() or lead[0] in ",;")
        out.append(("n" if number else "N" if name else "", w.lower()))
    return out


def test_reparameterised_items_against_brute_force(spark):
    rng = np.random.default_rng(12)
    draw = lambda n: [str(w) for w in rng.choice([f"{a}{b}" for a in "ka lo mi ru te".split() for b in "ben dor fal gim hus".split()], n)]
    name = lambda: str(rng.choice("Anna Bert Carl Dora Emil Fritz".split()))
    number = lambda: str(rng.integers(1, 9))
    items, texts = {}, []
    for k in range(12):
        form = [rng.choice(["w", "n", "N"], p=[0.7, 0.2, 0.1]) for _ in range(int(rng.integers(9, 30)))]
        lit = draw(len(form))
        fill = lambda form=form, lit=lit: " ".join({"w": w, "n": number(), "N": name()}[f] for f, w in zip(form, lit, strict=True))
        items[k] = fill()
        texts += [" ".join(draw(5)) + " " + t + " " + " ".join(draw(5)) for t in (items[k], fill(), fill(), " ".join(items[k].split()[3:]))]
    template = lambda t: [k or w for k, w in t]
    want = {}
    for d, text in enumerate(texts):
        own = plain_tokens(text)
        for i, item in items.items():
            b = plain_tokens(item)
            n = min(8, len(b))
            hits = []
            for p, q in product(range(len(own) - n + 1), range(len(b) - n + 1)):
                x, y = own[p : p + n], b[q : q + n]
                literal = 2 * sum(not k for k, _ in y) >= n
                if template(x) == template(y) and (literal or x == y):
                    hits.append((q, {(u, v) for u, v in zip(y, x, strict=True) if u[0]}))
            met = Counter(s for _, slots in hits for s in slots)
            first = lambda pairs: min(pairs, key=lambda s: (-met[s], s[1][1], s[0][1]))
            holds = {s for s in met if s == first([t for t in met if t[0] == s[0]])}
            holds = {s for s in holds if s == min((t for t in met if t[1] == s[1]), key=lambda t: (-met[t], t[0][1]))}
            covered = {q for q, slots in hits if slots <= holds}
            if covered and len(covered) >= min(6, -(-(len(b) - n + 1) // 2)):
                want[d, i] = len(covered)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_windows"] for r in decontaminate.contamination(documents(spark, texts), bench).collect()}
    assert len(want) > 15
    assert got == want


def test_decontamination_of_odd_input(spark):
    bench = table(spark, SF, "benchmark")
    assert decontaminate.contamination(odd(spark), bench).count() == 0
    assert decontaminate.contamination(odd(spark).limit(0), bench).count() == 0
    assert decontaminate.contamination(odd(spark), bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(odd(spark), bench)
    assert kept.count() == 10
    assert kept.columns == odd(spark).columns


def shared_runs(low, least=50):
    """(doc, lo, hi) of all maximal runs of words that lie whole in another document."""
    places = defaultdict(lambda: defaultdict(list))
    for d, w in low.items():
        for i in range(len(w) - least + 1):
            places[tuple(w[i : i + least])][d].append(i)
    starts = defaultdict(set)
    for own in places.values():
        for d, e in ((d, e) for d in own for e in own if d != e):
            starts[d, e] |= {(i, j - i) for i in own[d] for j in own[e]}
    for (d, _), found in starts.items():
        for i, shift in found:
            if (i - 1, shift) not in found:
                hi = i
                while (hi, shift) in found:
                    hi += 1
                yield d, i, hi - 1 + least


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for v in a:
        last = 0
        for j, w in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if v == w else max(row[j], row[j - 1])
    return row[-1]


def assert_truthful(rows, low):
    for r in rows:
        part = low[r["doc_id"]][r["first_word"] : r["end_word"]]
        assert r["words"] == len(part) >= 50
        if r["source_doc_id"] != r["doc_id"]:
            assert longest_common(part, low[r["source_doc_id"]]) >= 0.8 * len(part) - 1e-9


def test_repeated_passages_against_all_shared_runs(spark):
    low = {r["doc_id"]: (r["text"] or "").lower().split() for r in table(spark, SF, "documents").collect()}
    spans, rows = defaultdict(list), passages.query(spark, SF).collect()
    for r in rows:
        spans[r["doc_id"]].append((r["first_word"], r["end_word"]))
    runs = set(shared_runs(low))
    assert len(runs) > 10
    assert not [(d, lo, hi) for d, lo, hi in runs if not any(a <= lo and hi <= b for a, b in spans[d])]
    assert_truthful(rows, low)


def spans_of(spark, texts):
    found = passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()
    return {(r["doc_id"], r["first_word"], r["end_word"], r["source_doc_id"]) for r in found}


def test_links_and_lengths_of_passages(spark):
    rng = np.random.default_rng(9)
    draw = lambda n: list(rng.choice([f"w{i}" for i in range(50_000)], n, replace=False))
    shared = draw(84)
    parts = [draw(9) + shared[7 * k : 7 * k + 18] + draw(9) for k in range(10)]
    assert spans_of(spark, [*parts, draw(20) + shared + draw(9), draw(5) + shared]) == {(10, 20, 104, 10), (11, 5, 89, 10)}
    joined = [p[: 28] for p in (draw(60), draw(60), draw(60))]
    assert spans_of(spark, [*(draw(9) + p + draw(9) for p in joined), draw(5) + sum(joined, []) + draw(5)]) == set()
    short = " ".join(draw(49))
    ends = [f"{short}\n", f" {short}", f"{short}\n one", f"\n{short} one\n"]
    got = passages.repeated_passages(documents(spark, ends)).collect()
    assert {(r["doc_id"], r["first_word"], r["end_word"]) for r in got} == {(2, 0, 50), (3, 0, 50)}
    exact = [draw(9) + (run := draw(50)) + draw(9), draw(3) + run + draw(8)]
    assert spans_of(spark, exact) == {(0, 9, 59, 0), (1, 3, 53, 0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(b"a b c d".split()), max_size=40), st.lists(st.sampled_from(b"a b c d".split()), max_size=40))
def test_common_words(a, b):
    assert passages.common_words(a, b) == longest_common(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=5, max_size=60), st.integers(5, 12))
def test_long_seeds_are_equal_for_equal_runs(words, length):
    one = passages.word_hashes([str(w).encode() for w in words])
    h, at = passages.long_seeds(one, np.arange(len(words)), length)
    assert at.tolist() == list(range(max(0, len(words) - length + 1)))
    for i, j in combinations(at.tolist(), 2):
        assert (h[i] == h[j]) == (words[i : i + length] == words[j : j + length])


def test_fuzzy_passages(spark):
    rng = np.random.default_rng(3)
    draw = lambda n: list(rng.choice([f"w{i}" for i in range(5000)], n))
    shared = draw(90)
    fuzzy = [w if i % 23 else "other" for i, w in enumerate(shared)]
    texts = [draw(60) + shared + draw(60), draw(30) + fuzzy + draw(50), draw(200), draw(20) + shared[:30] + draw(20)]
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()
    rows = {r["doc_id"]: r for r in got}
    assert set(rows) == {0, 1}
    assert abs(rows[1]["first_word"] - 30) <= 2
    assert abs(rows[1]["end_word"] - 120) <= 2
    assert rows[1]["source_doc_id"] == 0
    assert 0.9 < rows[1]["identity"] < 1


def test_passages_around_a_rewritten_middle(spark):
    rng = np.random.default_rng(4)
    draw = lambda n: list(rng.choice([f"w{i}" for i in range(50_000)], n, replace=False))
    one, two, texts = draw(60), draw(60), []
    for gap in (60, 60, 150):
        texts.append(draw(30) + one + draw(gap) + two + draw(30))
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()
    spans = sorted((r["doc_id"], r["first_word"], r["end_word"]) for r in got)
    assert spans == [(0, 30, 90), (0, 150, 210), (1, 30, 90), (1, 150, 210), (2, 30, 90), (2, 240, 300)]


def test_passages_whose_parts_occur_earlier(spark):
    rng = np.random.default_rng(8)
    draw = lambda n: list(rng.choice([f"w{i}" for i in range(50_000)], n, replace=False))
    texts, want = [], {}
    for k in range(20):
        shared = draw(60)
        texts += [draw(20) + shared[i : i + 20] + draw(20) for i in (0, 20, 40)]
        want |= {len(texts): (10 + k, 70 + k), len(texts) + 1: (30, 90)}
        texts += [draw(10 + k) + shared + draw(9), draw(30) + shared + draw(12)]
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()
    assert {r["doc_id"]: (r["first_word"], r["end_word"]) for r in got} == want


def test_chains_against_all_chains():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        x, y = rng.permutation(60)[:n], rng.permutation(60)[:n]
        best = 0.0
        for k in range(1, n + 1):
            for own in combinations(sorted(range(n), key=lambda i: x[i]), k):
                if all(y[a] < y[b] for a, b in zip(own, own[1:], strict=False)):
                    gaps = sum(passages.GAP_COST * (x[b] + y[b] - x[a] - y[a]) for a, b in zip(own, own[1:], strict=False))
                    best = max(best, passages.K * k - gaps)
        chain = passages.chains(x, y)[0]
        gaps = sum(passages.GAP_COST * (x[b] + y[b] - x[a] - y[a]) for a, b in zip(chain, chain[1:], strict=False))
        assert np.isclose(passages.K * len(chain) - gaps, best)


def test_holders_of_common_seeds(spark):
    rng = np.random.default_rng(3)
    spots = sorted({(int(d), int(h), int(a)) for d, h, a in zip(rng.integers(0, 60, 600), rng.integers(0, 12, 600), rng.integers(0, 9, 600), strict=True)})
    seen, rows = set(), []
    for d, h, a in spots:
        rows.append((d, h, a, h % 2 == 0, (d, h) not in seen))
        seen.add((d, h))
    found = spark.createDataFrame([*rows, (1, 99, 0, False, True)], "doc_id long, h long, at int, long boolean, first boolean")
    by_seed = defaultdict(list)
    for d, h, a, _, first in rows:
        by_seed[h].append((d, a, first))
    want = Counter()
    for h, own in by_seed.items():
        for i, (d, a, _) in enumerate(own):
            last = [(s, b) for s, b, first in own[max(0, i - passages.HOLDERS) : i] if first]
            want[(d, a, h % 2 == 0, (*last, own[0][:2]))] += 1
    read = lambda df: [(r["doc_id"], r["at"], r["long"], tuple((x["source"], x["s_at"]) for x in r["holders"])) for r in df.collect()]
    assert Counter(read(passages.with_holders(found))) == want
    dealt = read(passages.with_holders(found, ordered=10))
    assert Counter((d, a, k, own[-1]) for d, a, k, own in dealt) == Counter((d, a, k, own[-1]) for d, a, k, own in want.elements())
    assert all((s, b) == own[-1] or s <= d for d, _, _, own in dealt for s, b in own)
    assert any(len(own) > 1 for *_, own in dealt)


def test_passages_of_two_texts_under_one_id(spark):
    one, two = " ".join(f"a{i}" for i in range(70)), " ".join(f"b{i}" for i in range(70))
    docs = documents(spark, [one, two, one, two], [1, 1, 2, 3])
    assert {r["doc_id"] for r in passages.repeated_passages(docs).collect()} in ({1, 2}, {1, 3})


def test_passages_of_odd_input(spark):
    got = passages.repeated_passages(odd(spark)).collect()
    assert {r["doc_id"] for r in got} <= {6}
    assert passages.repeated_passages(odd(spark).limit(0)).count() == 0


def test_an_exact_run_among_many_holders_of_its_parts(spark, monkeypatch):
    """Two documents share 60 words of which 30 others, before and between them,
    hold 49 each: the run is found, however the long seeds are dealt."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    text = lambda n: [word() for _ in range(n)]
    run = text(60)
    docs = {10: text(30) + run + text(30), 100: text(40) + run + text(20)}
    for k, i in enumerate([1, 2, 3, *range(11, 38)]):
        docs[i] = text(20) + run[k % 12 : k % 12 + 49] + text(20)
    for ordered in (passages.ORDERED, 4):
        monkeypatch.setattr(passages.with_holders, "__defaults__", (ordered,))
        got = passages.repeated_passages(documents(spark, [" ".join(t) for t in docs.values()], list(docs))).collect()
        assert {(r["doc_id"], r["source_doc_id"]) for r in got} >= {(100, 10), (10, 10)}
        (r,) = [r for r in got if r["doc_id"] == 100]
        assert r["first_word"] <= 40 and r["end_word"] >= 100


def test_every_exact_run_is_covered_in_a_crowd(spark):
    """Random cuts of a few long passages in many documents: every run of 50 words
    that two documents share lies in reported passages, word by word."""
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    long = [text(140) for _ in range(2)]
    docs = []
    for _ in range(70):
        own = text(rng.randrange(10))
        for p in rng.sample(long, rng.randrange(1, 3)):
            a = rng.randrange(95)
            own += p[a : a + rng.randrange(44, 70)] + text(rng.randrange(1, 9))
        docs.append(own)
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in docs])).collect()
    covered = defaultdict(set)
    for r in got:
        covered[r["doc_id"]] |= set(range(r["first_word"], r["end_word"]))
    holders = defaultdict(set)
    for d, t in enumerate(docs):
        for i in range(len(t) - 49):
            holders[tuple(t[i : i + 50])].add(d)
    missed = [(d, i) for d, t in enumerate(docs) for i in range(len(t) - 49) if len(holders[tuple(t[i : i + 50])]) > 1 and not set(range(i, i + 50)) <= covered[d]]
    assert not missed


def test_fuzzy_passages_are_mostly_found(spark):
    """Pairs of 100 words with a share of them changed at random."""
    rng = random.Random(10)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    for share, least in ((0.05, 58), (0.1, 57), (0.15, 50)):
        docs = []
        for _ in range(60):
            own = text(100)
            docs += [text(20) + own + text(20), text(30) + [w if rng.random() > share else "changed" + str(rng.random()) for w in own] + text(10)]
        got = passages.repeated_passages(documents(spark, [" ".join(t) for t in docs])).collect()
        assert len({r["doc_id"] // 2 for r in got if r["doc_id"] != r["source_doc_id"]}) >= least


def test_parity_bits_never_overstate_a_difference():
    rng = np.random.default_rng(3)
    for n, m, both in ((0, 0, 0), (1, 1, 1), (5, 9, 5), (100, 130, 90), (100, 90, 0), (3000, 2500, 2400), (33, 31, 30)):
        pool = np.unique(rng.integers(0, 2**63, n + m - both, dtype=np.uint64))
        a, b = pool[:n], pool[n - both :]
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        found = simhash.least_difference(simhash.parity_bits(a), simhash.parity_bits(b))
        assert found <= differ and (differ == 0 or found > differ / 4)


def test_a_changed_passage_among_many_holders_of_its_seeds(spark):
    """Two documents share 100 words but for some changed ones; 40 others, before,
    between and after them, hold pieces of it too short to be passages, so that each
    of its seeds has more holders than are joined at once."""
    rng = random.Random(12)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    run = text(100)
    fuzzy = [w if i % 19 else f"other{i}" for i, w in enumerate(run)]
    docs = {20: text(30) + run + text(30), 60: text(40) + fuzzy + text(20)}
    for k, i in enumerate([*range(12), *range(21, 59), *range(61, 70)]):
        docs[i] = sum((text(20) + run[max(a, 0) : max(a + 24, 0)] + text(20) for a in range(k * 7 % 43 - 43, 100, 43)), [])
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in docs.values()], list(docs))).collect()
    assert {(r["doc_id"], r["source_doc_id"]) for r in got} == {(20, 20), (60, 20)}
    (r,) = [r for r in got if r["doc_id"] == 60]
    assert r["first_word"] <= 44 and r["end_word"] >= 136 and 0.9 < r["identity"] < 1


def test_meetings_against_all_pairs(spark):
    """Seeds of few documents meet in full, all others are told to be crowded,
    wherever an Arrow batch ends."""
    rng = np.random.default_rng(5)
    spots = {(int(d), int(h), int(a)) for d, h, a in zip(rng.integers(0, 300, 3000), rng.geometric(0.02, 3000), rng.integers(0, 40, 3000), strict=True)}
    spots |= {(int(d), 1000 + int(h), 1) for d, h in zip(rng.integers(0, 300, 600), rng.integers(0, 150, 600), strict=True)}
    seen, rows, by_seed = set(), [], defaultdict(list)
    for d, h, a in sorted(spots):
        rows.append((d, h, a, (d, h) not in seen, False, h % 50 == 7))
        by_seed[h].append((d, a, (d, h) not in seen))
        seen.add((d, h))
    found = spark.createDataFrame(rows, "doc_id long, h long, at int, first boolean, again boolean, bare boolean")
    want, crowded = set(), set()
    for h, own in by_seed.items():
        if sum(first for *_, first in own) > passages.HOLDERS + 1:
            crowded |= {(d, h, a) for d, a, _ in own}
        else:
            want |= {(d, h, a, s, b) for d, a, _ in own for s, b, first in own if first and s < d}
    assert want and crowded
    for size in ("10000", "7"):
        with_size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = passages.meetings(found).collect()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_size)
        assert Counter((r["doc_id"], r["h"], r["at"], r["source"], r["s_at"]) for r in got if r["s_at"] >= 0) == Counter(want)
        assert {(r["doc_id"], r["h"], r["at"]) for r in got if r["s_at"] < 0 and r["docs"] > passages.HOLDERS + 1} == crowded
        assert {r["h"] for r in got if r["bare"]} == {h for _, h, _ in crowded} | {h for h in by_seed if h % 50 == 7}


def aligned_pairs(spark, monkeypatch, texts):
    """Rows of ``repeated_passages`` and the number of pairs that were aligned for it."""
    chained, settle = [], passages.settle

    def told(df, label):
        out = settle(df, label)
        if label == "chains":
            chained.append(out.count())
        return out

    monkeypatch.setattr(passages, "settle", told)
    got = passages.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()
    monkeypatch.setattr(passages, "settle", settle)
    return got, sum(chained)


def test_runs_of_one_word_are_not_paired_among_all_holders(spark, monkeypatch):
    """Documents with runs of one word too short for a passage: what is aligned does
    not grow with the square of their number, and those that share more are found."""
    rng = random.Random(13)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    crowd = [text(30) + ["no"] * (16 + i % 32) + text(30) for i in range(60)]
    got, aligned = aligned_pairs(spark, monkeypatch, crowd)
    assert not got and aligned <= 10 * 60
    end = text(6)
    two = [text(20) + ["no"] * 44 + text(1) + end + text(20), text(35) + ["no"] * 44 + text(1) + end + text(9)]
    start = text(5)
    more = [text(20) + start + text(1) + ["no"] * r + text(20) for r in (45, 47)]
    got, aligned = aligned_pairs(spark, monkeypatch, crowd + two + more)
    assert {(r["doc_id"], r["first_word"], r["end_word"], r["source_doc_id"]) for r in got} == {(60, 20, 71, 60), (61, 35, 86, 60), (62, 20, 71, 62), (63, 20, 71, 62)}
    assert aligned <= 10 * 64


def test_copies_of_a_passage_are_aligned_with_one_document(spark, monkeypatch):
    """Nine documents that hold one text, each with two words changed: the number of
    aligned pairs grows with the documents, not with the square of a group's size."""
    rng = random.Random(14)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    texts = []
    for _ in range(10):
        whole = text(200)
        texts += [[w if i not in (40 + 9 * k, 150 - 9 * k) else f"other{k}" for i, w in enumerate(whole)] for k in range(9)]
    got, aligned = aligned_pairs(spark, monkeypatch, texts)
    assert {(r["doc_id"], r["first_word"], r["end_word"]) for r in got} == {(d, 0, 200) for d in range(90)}
    assert aligned <= 3 * 90


def test_a_long_run_of_one_word_is_found_whole(spark):
    """The longest run of one word has a partner as long: not only a shorter one's part
    is told, however many hold the shorter ones."""
    rng = random.Random(15)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    lengths = [*range(50, 70), 140, *range(50, 70), 150]
    got = passages.repeated_passages(documents(spark, [" ".join(text(20) + ["no"] * n + text(20)) for n in lengths])).collect()
    spans = {r["doc_id"]: (r["first_word"], r["end_word"]) for r in got}
    assert spans == {d: (20, 20 + min(n, 140)) for d, n in enumerate(lengths)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=6, max_size=40), st.lists(st.integers(0, 2), min_size=6, max_size=40), st.data())
def test_words_beside_seeds_never_understate_how_far_texts_go_on(a, b, data):
    x, y = data.draw(st.integers(0, len(a) - 5)), data.draw(st.integers(0, len(b) - 5))
    told = [passages.beside(passages.word_hashes([str(w).encode() for w in t]), np.array([p])) for t, p in ((a, x), (b, y))]
    left, right = passages.going_on(*told)
    alike = lambda pairs: next((n for n, (v, w) in enumerate(pairs) if v != w), min(len(pairs), 10**6))
    assert left[0] >= alike(list(zip(a[:x][::-1], b[:y][::-1], strict=False)))
    assert right[0] >= alike(list(zip(a[x + 5 :], b[y + 5 :], strict=False)))


def test_lines_that_many_documents_begin_and_end_with_make_no_pairs(spark, monkeypatch):
    """Documents of a common first and last line with other words between and after
    them: what is aligned does not grow with the square of their number, and two that
    share a changed passage around those lines are found."""
    rng = random.Random(16)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    begin, end = text(16), text(16)
    crowd = [begin + text(12 + i % 5) + end + text(20) for i in range(60)]
    inside, after = text(14), text(12)
    two = [begin + [*inside[:7], f"other{i}", *inside[7:]] + end + after + text(10) for i in range(2)]
    got, aligned = aligned_pairs(spark, monkeypatch, crowd + two)
    assert {(r["doc_id"], r["first_word"], r["end_word"], r["source_doc_id"]) for r in got} == {(60, 0, 59, 60), (61, 0, 59, 60)}
    assert aligned <= 10 * 62


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "Äb", "no", "longer-than-eight"]), max_size=40), max_size=5), st.sampled_from([" ", "\n", " \t ", "\x0b"]), st.sampled_from([1, 50, 10**6]))
def test_seeds_of_texts_laid_out_together(texts, gap, held):
    """Each text's words are told apart and its seeds are the minimisers of its own windows."""
    told = {}
    for laid in passages.laid_out(pa.array([gap + gap.join(t) for t in texts], pa.string()), held):
        _, at, _, _ = passages.seeds(laid)
        for i, d in enumerate(laid.doc.tolist()):
            one = laid.one[laid.begin[i] : laid.begin[i] + laid.length[i]]
            words = passages.words_of(gap.join(texts[d]))
            assert len(one) == len(words) and all(told.setdefault(w, h) == h for w, h in zip(words, one.tolist(), strict=True))
            grams = [tuple(one[p : p + 5].tolist()) for p in range(len(one) - 4)]
            own = (at[laid.owner(at) == i] - laid.begin[i]).tolist()
            assert all(any(p in own for p in range(s, s + 10)) for s in range(len(grams) - 9)) and bool(own) == bool(grams)
    assert len(set(told.values())) == len(told)
