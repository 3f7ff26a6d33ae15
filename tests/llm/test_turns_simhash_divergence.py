"""Conversation repair, SimHash classes and source divergence against brute force and SQL, with their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import divergence, simhash, turns
from textloom.llm.queries import oracle_sql, queries

SPACE = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string, place long, kind string, segment int"


# --- conversation repair ---


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def repair(rows):
    """Of one conversation's turns (turn, role, text) the expected row: every edit tried from every state of the pattern."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, kinds = set(), []
    for _, r, x in rows:
        kinds.append("blank" if not x.strip(SPACE) else "duplicate" if (r, x) in seen else "truncated" if x.rstrip(SPACE)[-1] not in ".!?" else "sound")
        seen.add((r, x))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    best = {(0, 0): (0, "", [])}

    def reach(key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value

    for i in range(len(rows) + 1):
        for s in (0, 1, 2, 3, 0, 1, 2, 3):  # twice: two inserts may follow each other
            if (i, s) in best:
                cost, audit, lines = best[i, s]
                reach((i, 3 if s == 2 else 2), (cost + 2, audit + "I", [*lines, "assistant:" if s == 2 else "user:"]))
        for s in range(4) if i < len(rows) else ():
            if (i, s) not in best:
                continue
            (_, r, x), (cost, audit, lines) = rows[i], best[i, s]
            reach((i + 1, s), (cost + 3, audit + "D", lines))
            if kinds[i] in ("blank", "duplicate"):
                continue
            more = kinds[i] == "truncated"
            role = "assistant" if s == 2 else "user"
            if s == 0 and r[:1] == "s":
                reach((i + 1, 1), (cost + more, audit + "K", [*lines, f"{r}:{x}"]))
            if r[:1] == role[0]:
                reach((i + 1, 5 - s if s > 1 else 2), (cost + more, audit + "K", [*lines, f"{r}:{x}"]))
            reach((i + 1, 5 - s if s > 1 else 2), (cost + more + 2, audit + "R", [*lines, f"{role}:{x}"]))
    cost, audit, lines = min((best[len(rows), s] for s in (0, 3) if (len(rows), s) in best), key=lambda v: v[:2])
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))


def repairs(rows):
    by = defaultdict(list)
    for c, *turn in rows:
        by[c].append(tuple(turn))
    return {(c, *repair(v)) for c, v in by.items()}


def told(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], TURNS)


def conversations(seed, lengths):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    text = lambda: rng.choice(["a.", "b?", "c", "", " \t", None, "d! ", "long " * 20 + ".", f"x{rng.random()}."])
    return [(c, rng.choice([t, t, t, None, t // 2]), rng.choice(roles), text()) for c, n in lengths for t in range(n)]


@pytest.mark.parametrize("bits", [2, 8])
def test_repair_of_random_conversations(spark, monkeypatch, bits):
    """Segments of four turns and of 256 give what an exhaustive search gives, also where one conversation holds most of all rows."""
    monkeypatch.setattr(turns, "SEGMENT_BITS", bits)
    rows = conversations(bits, [(c, random.Random(c).choice([1, 2, 3, 6, 12])) for c in range(40)] + [(None, 5), (77, 500)])
    assert set(map(tuple, turns.repaired(turns.damaged(told(spark, rows))).collect())) == repairs(damage(rows))


def test_repair_edges(spark):
    rows = [(1, 1, "user", "hi."), (1, 2, "assistant", "yes."), (2, None, None, None), (3, 1, "system", "s."), (4, 5, "user", "a."), (4, 5, "user", "a."), (4, 9, "assistant", "b"),
            (5, 1, "assistant", "é" * 40_000 + "."), (6, 1, "system", "s."), (6, 2, "system", "s!"), (6, 3, "user", "u.")]
    got = {r.conv_id: r for r in turns.repaired(told(spark, rows)).collect()}
    assert {tuple(r) for r in got.values()} == repairs([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert (got[1].cost, got[1].audit, got[1].repaired) == (0, "KK", "user:hi.\nassistant:yes.")
    assert (got[2].blank, got[2].audit, got[2].repaired) == (1, "D", "")
    assert (got[4].duplicate, got[4].truncated, got[4].gaps, got[4].cost) == (1, 1, 3, 4)
    assert turns.repaired(told(spark, rows).limit(0)).count() == 0


def test_every_conversation_is_returned(spark, tmp_path):
    """Conversations of which the damage leaves nothing have zeros, an empty audit and the digest of nothing."""
    rows = [(c, 1, "user", "a.") for c in range(40)]
    told(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries()["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    gone = set(range(40)) - {c for c, *_ in damage(rows)}
    assert len(got) == 40 and gone
    assert all(tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)


def test_repair_plan_is_native(spark, data):
    plan = queries()["op11_conversation_repair"](spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- SimHash ---


def simple_print(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    k = min(4, len(found))
    h = [xxhash.xxh64(" ".join(found[i : i + k]).encode(), seed=42).intdigest() for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def parts_of(prints, ids, radius=4):
    """The smallest identifier that each row reaches, by comparing all pairs."""
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[top(i)] = top(j)
    least = defaultdict(list)
    for i, v in enumerate(ids):
        least[top(i)] += [] if v is None else [v]
    return [min(least[top(i)], default=None) for i in range(len(prints))]


@given(st.text(alphabet="aB É\t\x0b \x85.", max_size=200))
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_the_majority(text):
    assert simhash.fingerprint(text.encode()) == simple_print(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(f"w{i * i % 997}" for i in range(70_000))
    assert simhash.fingerprint(text.encode()) == simple_print(text)


def test_simhash_links(spark, monkeypatch):
    """Chains of fingerprints a few bits apart: all pairs within the radius are joined, and none beyond, also where prefixes have to be lengthened."""
    rng = random.Random(4)
    prints = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 12])):
            prints.append(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                at ^= 1 << b
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    for room in (simhash.ROOM, 20_000, 300):
        monkeypatch.setattr(simhash, "ROOM", room)
        found = simhash.components(simhash.links(nodes))
        root = {r.cid: r.root for r in found.collect()}
        want = parts_of(prints, signed)
        assert [root.get(p, p) for p in signed] == want


def test_simhash_one_dense_ball(spark):
    """A thousand fingerprints around one centre: all linked, by fewer links than pairs."""
    rng = random.Random(1)
    prints = {sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2]))) for _ in range(1000)}
    nodes = spark.createDataFrame([(p,) for p in np.array(sorted(prints), np.uint64).view(np.int64).tolist()], "print long")
    made = simhash.links(nodes)
    assert made.count() < 40 * len(prints)
    assert simhash.components(made).select("root").distinct().count() == 1


def test_simhash_edges(spark):
    rows = [(1, "a b c d e"), (2, "A  B c d e"), (3, None), (4, ""), (5, " \t"), (None, "a b c d e"), (None, "z"), (6, "z z"), (6, "q"), (7, "É é x y z " * 5000)]
    docs = spark.createDataFrame([(i, t, 9, "x", 1) for i, t in rows], "doc_id long, text string, print long, prefix string, root int")
    got = simhash.classes_of(docs).collect()
    prints = [simple_print(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c, i == c) for (i, _), p, c in zip(rows, prints, parts_of(prints, [i for i, _ in rows]), strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.classes_of(docs.limit(0)).count() == 0


def test_simhash_query_against_all_pairs(spark, data):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = sorted(rows)
    prints = [simple_print(rows[i]) for i in ids]
    want = {(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, parts_of(prints, ids), strict=True)}
    assert set(map(tuple, queries()["op12_simhash_near_dedup"](spark, data).collect())) == want


# --- divergence ---


def audit(rows, least, reported):
    """Rows (lang, source, text) by plain dictionaries and long integers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda of: {t: 1 + 10**9 * (of[t] + 5) // (sum(of[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            terms = [("term", t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, most in ((pairs, None), (terms, reported)):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most]
                out |= {(lang, s, *x, n) for n, x in enumerate(ranked, 1)}
    return out


def corpus(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, item string")


def mixed(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abAé日ß", k=rng.choice([1, 2, 2, 3, 9]))) for _ in range(60)]
    return [(rng.choice(["x", "y", None]), rng.choice(["s1", "s2", "s2", "s2", "s3", None]), rng.choice([" ", "1", "--", "\x00"]).join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for _ in range(n)]


@pytest.mark.parametrize(("cells", "counted", "terms"), [(divergence.CELLS, divergence.COUNTED, divergence.TERMS), (10, 2, 3)])
def test_divergence_of_random_texts(spark, monkeypatch, cells, counted, terms):
    """Also where tries are handed on after every few cells and compared a few terms at a time."""
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "COUNTED", counted)
    monkeypatch.setattr(divergence, "TERMS", terms)
    rows = mixed(terms, 300)
    assert set(map(tuple, divergence.audit(corpus(spark, rows), least=4, reported=5).collect())) == audit(rows, 4, 5)


@pytest.mark.parametrize("slots", [26, 17])
def test_slots_lose_no_term(spark, monkeypatch, slots):
    """With few slots more terms pass than are kept, and none is missing."""
    monkeypatch.setattr(divergence, "SLOTS", slots)
    rows = mixed(slots, 200)
    assert set(map(tuple, divergence.audit(corpus(spark, rows), least=9, reported=5).collect())) == audit(rows, 9, 5)


def test_divergence_edges(spark):
    """Languages without kept terms, sources without terms, one source alone, nulls, long texts, equal values in the order of their bytes."""
    rows = [("a", "s", "x"), ("a", "t", None), ("a", None, ""), (None, "only", "q q q")] + [("b", s, "z é a B " + s) for s in ("u", "v") for _ in range(3)] + [("b", "w", "12 !"), ("b", "v", "long" * 30_000)]
    got = set(map(tuple, divergence.audit(corpus(spark, rows), least=3, reported=2).collect()))
    assert got == audit(rows, 3, 2)
    assert {r[4] for r in got if r[0] == "a"} == {0} and not [r for r in got if r[0] == ""]
    assert divergence.audit(corpus(spark, rows).limit(0)).count() == 0


@given(st.lists(st.binary(min_size=1, max_size=6), max_size=60))
@settings(max_examples=200, deadline=None)
def test_tries_hold_sorted_terms_and_their_cells(words):
    """What goes into a trie comes out of its blocks: in byte order, with documents and occurrences."""
    trie, counts = divergence.Trie(), Counter(words)
    number = {w: trie.leaf(w) for w in words}
    assert trie.leaves and [(t, i) for t, i in trie.leaves()] == sorted(number.items()) and trie.size == len(counts)
    docs = np.zeros(trie.size, np.int64)
    for w, n in counts.items():
        docs[number[w]] = n
    rows = np.array([number[w] for w in counts] * 2, np.int64)
    codes = np.repeat(np.arange(2), len(counts))
    cells = np.array([*counts.values(), *(2 * n for n in counts.values())], np.int64)
    told = []
    for block in divergence._blocks("l", trie, ["s", "t"], docs, rows, codes, cells):
        row, code, n = divergence._cells(block)
        terms = divergence._terms(block)
        assert all(t[: divergence.PREFIX] == block[1] for t in terms) and block[2] == ["s", "t"]
        told += [(t, int(d), n[row == i].tolist(), code[row == i].tolist()) for i, (t, d) in enumerate(zip(terms, np.frombuffer(block[6], "<i8"), strict=True))]
    assert told == [(w, n, [n, 2 * n], [0, 1]) for w, n in sorted(counts.items())]


@given(st.lists(st.tuples(st.integers(0, 10**15), st.integers(1, 2**53)), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_shares_are_exact(pairs):
    pairs = [(min(a, b), b) for a, b in pairs]
    a, b = np.array(pairs, np.int64).T
    assert divergence.shares(a, b).tolist() == [1 + 10**9 * x // y for x, y in pairs]


def test_terms_are_runs_of_letters():
    assert divergence.terms_of("Ab1c-É\xa0d\x85 [Z]`~".encode()) == [w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "ab1c-É\xa0d\x85 [z]`~")]
    assert divergence.terms_of(None) == []


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_source_divergence"])
def test_new_queries_match_sql(spark, data, duck, same_rows, name):
    same_rows(queries()[name](spark, data), duck.sql(oracle_sql()[name]))
