"""Prefix trie, spelling variants and line dedup against plain versions, on small inputs with all odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F
from reelshelf.llm import linedup, prefixtrie, spelling

#: Names that the operators use inside; a table may have them, too.
EXTRA = ("id", "n", "at", "kind", "run", "word", "part", "key", "h", "docs", "batch", "shard")


def with_extra(df):
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(EXTRA)]).repartition(3)


def key(row):
    return tuple((x is not None, str(type(x)), x if x is not None else 0) for x in row)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# --- 11
def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    nodes = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - c % 100, [])[:h] + v[h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    children, leaves, saved = Counter(k[:-1] for k in nodes if k), Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c, e in m if e)))
        up = min(nodes[k[:-1]])[0] if k else None
        out.append((min(m)[0], len(k), up, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=key)


def conversations(seed, count, turns=4, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), count):
        order = list(range(rng.randint(1, turns)))
        for t in order:
            rows.append((c, t if t or rng.random() < 0.8 else None, rng.choice(["user", "assistant", None]), rng.choice([None, "", *"abcé"[:texts]]) if rng.random() < 0.9 else "long " * 50))
    return rows


def in_order(rows):
    """One row a turn number, so that the order is defined without the digest."""
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


@pytest.mark.parametrize("seed, count, block_turns, together", [(1, 60, 1, 2), (2, 120, 5, 2), (3, 200, 40, 64), (4, 1, 7, 3)])
def test_trie_equals_plain_version(spark, seed, count, block_turns, together):
    rows = in_order(conversations(seed, count))
    hot = [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(6)]  # one sequence for many conversations
    rows += hot if seed == 3 else []
    df = with_extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = prefixtrie.prefix_trie(df, block_turns, together)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(got) == plain_trie(rows)


def test_trie_odd_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    # a lone row without a conversation makes no node; a long text and long conversations count in code points
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 2, "user", "é" * 100_000), *[(600, t, "user", str(t)) for t in range(300)], *[(601, t, "user", str(t)) for t in range(300)]]
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, schema), 16, 2)
    assert rows_of(got) == plain_trie(rows)
    # equal turn numbers: some order, the same in every run
    ties = [(7, 1, "user", x) for x in "abcdefgh"] + [(7, 1, "user", "a")]
    df = spark.createDataFrame(ties, schema)
    first = rows_of(prefixtrie.prefix_trie(df))
    assert first == rows_of(prefixtrie.prefix_trie(df.repartition(3))) and max(r[1] for r in first) == 9


def test_ternary_tree_is_balanced():
    tree = prefixtrie.TernaryTree()
    tree.put_sorted([([i, 7], [1, 1], [i]) for i in range(1023)])

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.less[node]), height(tree.more[node]))

    assert height(tree.top) == 10
    walk = tree.walk()
    assert [tree.turn[n] for n, d, _ in walk if d == 1] == list(range(1023)) and len(walk) == 2046


# --- 12
def plain_spelling(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: set() for w in words}
    same = {}
    for w in words:
        for k in range(len(w)):
            rest = w[:k] + w[k + 1 :]
            same.setdefault((k, rest), set()).add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()), key=key)


def spelled(seed, stems, times):
    rng = random.Random(seed)
    rows = []
    for i in range(stems):
        word = "".join(rng.choice("abcéÿà") for _ in range(rng.randint(7, 11)))
        variants = [word]
        for _ in range(12):
            w, k = rng.choice(variants), rng.randrange(7)
            variants.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿ") + w[k:], w[:k] + rng.choice("abz") + w[k + 1 :], w + w[-1], w.upper()]))
        weights = [times ** rng.randint(0, 3) for _ in variants]
        for w, n in zip(variants, weights):
            rows.append((rng.choice([i, None]), " ".join([w] * (n + 1))))
    return rows


@pytest.mark.parametrize("shard_entries", [100_000, 40])
def test_spelling_equals_plain_version(spark, monkeypatch, shard_entries):
    monkeypatch.setattr(spelling, "SHARD_ENTRIES", shard_entries)  # small shards: beginnings go over several of them
    rows = spelled(5, 25, 11) + [(1, None), (2, ""), (3, "12 !? é"), (4, "a" * 70_000 + " " + "a" * 70_000 + " " + "a" * 69_999 + "b " + "a" * 69_999 + "b")]
    rows += rows[:3]
    df = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = spelling.spelling_groups(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = plain_spelling(rows)
    assert rows_of(got) == expected
    assert any(r[1] and r[1] != r[2] for r in expected)  # forms of forms
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_sorted_list_finds_all_pairs():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 9))) for _ in range(400)})
    words = [w for w in words if w.startswith("ab")]
    listed = spelling.SortedList(pa.array(words), np.zeros(len(words), int))
    i = np.arange(len(words))
    got = set(zip(*(x.tolist() for x in listed.near(listed, i, i + 1, np.repeat(len(words), len(words)), np.repeat(2, len(words))))))

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    assert got == {(x, y) for x in range(len(words)) for y in range(x + 1, len(words)) if one_edit(words[x], words[y])}


# --- 13
def plain_lines(rows, limit, least):
    spaces = " \t\n\x0b\x0c\r"
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(spaces))
    texts = [(d, (t or "").split("\n")) for d, t in rows]
    count = Counter(k for _, ls in texts for k in {low(x) for x in ls} if len(k) >= least)
    out = []
    for d, ls in texts:
        kept = [x for x in ls if not (len(low(x)) >= least and count[low(x)] >= limit)]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=key)


def lined(seed, count):
    rng = random.Random(seed)
    pool = ["Home", " home\t", "HOME\r", "É menu", "é menu", "", "  ", "\x0bx", "x", *[f"own {i}" for i in range(60)]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(count)]
    return rows + [rows[0]] * 4 + [(None, None), (None, ""), (None, "Home\n\nx\n"), (-3, "\n" * 40_000 + "x"), (-4, "x\n" * 30_000), (-5, "Home")]


@pytest.mark.parametrize("limit, least", [(10, 1), (2, 3), (1, 1)])
def test_lines_equal_plain_version(spark, limit, least):
    rows = lined(limit, 70)
    df = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = linedup.line_digests(df, limit, least)
    assert rows_of(got) == plain_lines(rows, limit, least)
    assert linedup.line_digests(df.limit(0), limit, least).count() == 0


def test_runs_are_compacted_and_add_up(spark):
    runs = linedup.LineRuns(spark, limit=5, fanout=2)
    rng = random.Random(1)
    total = Counter()
    for _ in range(7):
        batch = [(rng.randrange(12), 0) for _ in range(15)]
        total.update(batch)
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    assert rows_of(runs.frequent()) == sorted((k for k, n in total.items() if n >= 5), key=key)
    # a run meets a batch without a shuffle of its own, and lies above the batch's count
    counted = spark.createDataFrame([(1, 0)], "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("docs"))
    plan = runs.unsettled(counted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("LeftAnti") < plan.index("HashAggregate")
    runs.close()


def test_new_lines_of_each_batch(spark):
    runs = linedup.LineRuns(spark, limit=1, fanout=2)
    seen = []
    for i, texts in enumerate((["a\nb", "b\nc"], ["c\nd"], ["A\ne\ne"], ["e"])):
        docs = spark.createDataFrame([(10 * i + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        seen.append(sorted((r.doc_id, r.at) for r in linedup.new_lines(runs, docs).collect()))
    assert seen == [[(0, 0), (0, 1), (1, 0), (1, 1)], [(10, 1)], [(20, 1), (20, 2)], []]
    runs.close()
