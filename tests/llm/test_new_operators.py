"""Chat formatting, whitening and hard negatives against brute force, and their edge cases."""

import collections
import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import chat, hard_negatives, queries, whitening

sys.path.insert(0, str(Path(__file__).parent.parent))
import oracle  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_chat_format", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF) == ""


# ---- chat


def said_by(rows):
    """Turns of each conversation by a plain loop: null ids are conversations of their own."""
    groups = collections.defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(rows):
        groups[(conv, k if conv is None else 0)].append((turn is not None, turn or 0, role is not None, role, text or ""))
    out = []
    for (conv, _), turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2], t[3] or "", t[4]))
        said = "".join(f"{r or ''}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return collections.Counter(out)


CONTROLS = ["\\", "###", "####", "#####", "</turn>", "<next>", ": ", "\\h", "\\\\e", "\n", "</turn>\n", "### user: ", "<</turn>", "é", "😀", "\\z", "\\c"]


def test_texts_of_control_strings_read_back(spark):
    rng = random.Random(11)
    noise = lambda: "".join(rng.choice(CONTROLS + ["a", " b"]) for _ in range(rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "a: b", "###", "\\z", None, ""]), noise()) for c in range(60) for t in range(rng.randrange(1, 12))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    made = chat.format_conversations(frame)
    got = collections.Counter(tuple(r)[:5] for r in chat.digest(made).collect())
    assert got == said_by(rows)
    for r in made.collect():
        assert "".join(r.formatted[s.start : s.end] for s in r.loss) == "".join(r.formatted.encode()[s.byte_start : s.byte_end].decode() for s in r.loss)
        blocks = r.formatted.split("</turn>\n")[:-1]
        assert all(b.startswith("### ") and b.count("###") == 1 for b in blocks)
        names = [b.split(": ")[0] for b in blocks]
        assert all(a != b for a, b in zip(names, names[1:]))  # adjacent turns of a role are one block


def test_conversations_on_edge_cases(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 0, "assistant", "tie"), (1, None, "system", "first"), (1, 5, None, None), (2, 0, "assistant", None), (2, 1, "assistant", ""), (None, 0, "user", "alone"), (None, 1, "assistant", "alone, too"), (None, 1, "assistant", "alone, too"),
        (3, 0, "user", "long " * 200_000), (3, 1, "assistant", "Ünïcode 😀 " * 50_000),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss int").repartition(3)
    assert collections.Counter(tuple(r)[:5] for r in chat.digest(chat.format_conversations(frame)).collect()) == said_by(rows)
    assert chat.digest(chat.format_conversations(frame.limit(0))).count() == 0


def test_a_conversation_of_many_turns_takes_linear_time(spark):
    import time

    took = {}
    for n in (20_000, 80_000):
        frame = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("some words").alias("text"))
        began = time.time()
        r = chat.digest(chat.format_conversations(frame)).first()
        took[n] = time.time() - began
        assert (r.n_turns, r.loss_chars) == (n, 10 * (n - (n + 2) // 3))
    assert took[80_000] < 30 and took[80_000] < 10 * took[20_000]


def test_formatting_is_native(spark):
    plan = queries.op11_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# ---- whitening


def plain_covariance(vectors):
    """Exact covariance of x by Python's integers, rounded once."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return x, s, np.array([[float(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3) for j in range(d)] for i in range(d)])


def whitened(frame):
    rows = whitening.whiten(frame).collect()
    return {(r.vec_id, r.component): r for r in rows}, rows


@pytest.mark.parametrize("kind", ["plain", "offset", "twins", "rank"])
def test_whitening_equals_exact_arithmetic(spark, kind):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(120, 10)) * np.array([3, 2, 2, 1, 1, 0.5, 0.3, 0.2, 0.1, 0.05])
    v = v + 1e4 if kind == "offset" else np.concatenate([v, v @ np.linalg.qr(rng.normal(size=(10, 10)))[0]]) if kind == "twins" else v[:, :3] @ rng.normal(size=(3, 10)).round() * 1.0 if kind == "rank" else v
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(4)
    found, rows = whitened(frame)
    x, s, cov = plain_covariance(v)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    n, k = len(x), max(r.component for r in rows)
    assert k == 8 and len(rows) == 8 * n and {r.n for r in rows} == {n}
    assert all(found[i, 1].deviation == sum((n * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(n))
    got = np.array([[found[i, c + 1].whitened for c in range(k)] for i in range(n)])
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    want = centred @ q / np.sqrt(e)
    # what rounding the covariance leaves open: of rank three and integers around it, five variances are some 10^-8 of the first
    loose = 1e-4 if kind == "rank" else 1e-6
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < loose
    assert np.allclose([found[0, c + 1].explained for c in range(k)], e / np.trace(cov), rtol=1e-6) and 0 <= rows[0].identity_error < loose / 100
    assert np.abs(np.cov(got.T, bias=True) - np.eye(k)).max() < loose / 100


def test_whitening_on_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.0, 0.5]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [5.0])]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, component int, vector string").repartition(3)
    found = collections.Counter((r.vec_id, r.component) for r in whitening.whiten(frame).collect())
    assert found == {(i, c): k for i, k in ((1, 2), (2, 1), (None, 1)) for c in (1, 2)}
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id = 1")).count() == 0  # equal rows have no variance
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, -k * 1.0]) for k in range(5)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(k, [1e300 * (-1) ** k, float(k)]) for k in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten(huge).collect()
    assert len(got) >= 4 and {r.deviation for r in got} == {None}


@pytest.mark.parametrize("values", [[5] * 6 + [4] * 10 + [1] * 32, [1] * 48, [3, 3, 3] + [0] * 45, [1e6] + [1] * 47, [0] * 48, [1 + 1e-14 * k for k in range(48)], [2.0**-k for k in range(48)]])
def test_components_of_clustered_eigenvalues(values):
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    m = (u * np.array(values, dtype=float)) @ u.T
    m = (m + m.T) / 2
    e, q = whitening.components(m, 8)
    scale = max(np.abs(m).max(), 1e-290)
    assert np.abs(e - np.sort(np.linalg.eigvalsh(m))[::-1][:8]).max() <= 1e-13 * scale * 48
    assert np.abs(m @ q - q * e).max() <= 1e-13 * scale * 48 and np.abs(q.T @ q - np.eye(8)).max() < 1e-12
    assert list(e) == sorted(e, reverse=True)


# ---- hard negatives


def plain_negatives(rows, positives=5, negatives=3, every=50):
    good = [(i, c, [int(np.floor(256 * np.float64(a))) for a in v]) for i, v, c in rows if c is not None and v is not None and all(a is not None and np.isfinite(a) for a in v)]
    good = list({(i, c, tuple(v)): None for i, c, v in good})
    out = []
    for i, c, v in good:
        if i is None or i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        ranked = sorted(((-score(w), j is None, j or 0, j, d) for j, d, w in good if len(w) == len(v) and j != i), key=lambda t: t[:3])
        for p in [t for t in ranked if t[4] == c][:positives]:
            fits = [t for t in ranked if t[4] != c and -50 * p[0] <= -100 * t[0] <= -95 * p[0]][:negatives]
            out += [(i, p[3], k + 1, t[3], -p[0], -t[0]) for k, t in enumerate(fits)]
    return collections.Counter(out)


def found_negatives(frame, **more):
    return collections.Counter(tuple(r)[:6] for r in hard_negatives.mine(frame, every=10, **more).collect())


def embedded(n=400, d=20, seed=13):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    return [(k, (centres[k % 4] + 0.9 * rng.normal(size=d) + 1.5 * centres.sum(0)).round(2).tolist(), k % 3 if k % 11 else 0) for k in range(n)]


SHAPE = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("cut", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, cut):
    """Also with a grid of many cells, and blocks smaller than a cell."""
    if cut:
        for name, value in (("ANCHOR_ROWS", 7), ("LEAST_ROWS", 50), ("MOST_ROWS", 50), ("ANCHORS_AT_ONCE", 3), ("CANDIDATES_AT_ONCE", 11)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = embedded()
    want = plain_negatives(rows, every=10)
    assert found_negatives(spark.createDataFrame(rows, SHAPE).repartition(5)) == want and len(want) > 100


def test_hard_negatives_on_edge_cases(spark):
    nan = float("nan")
    rows = embedded(120)
    rows += [rows[7], rows[7], (500, None, 1), (510, [1.0, nan] + [1.0] * 18, 1), (520, [1.0] * 20, None), (530, [None] * 20, 1), (540, [1.0, 2.0], 1), (541, [1.0, 2.0], 1), (542, [0.9, 1.5], 2), (550, [], 1), (551, [], 1), (None, rows[3][1], 2), (None, rows[4][1], 0)]
    rows += [(600 + k, rows[10][1], k % 2) for k in range(40)]  # ties
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SHAPE + ", score int, row string").repartition(4)
    assert found_negatives(frame) == plain_negatives(rows, every=10)
    assert hard_negatives.mine(frame.limit(0)).count() == 0 and hard_negatives.mine(frame.where("vec_id = 7")).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 1), (51, [1.0, 2.0], 2)], SHAPE)
    assert hard_negatives.mine(one).count() == 0  # no positive
    twice = [(50, [1.0, 2.0], 1), (50, [1.0, 2.5], 1), (51, [1.0, 2.0], 1), (52, [0.8, 1.6], 2)]
    got = hard_negatives.mine(spark.createDataFrame(twice, SHAPE)).collect()
    assert len(got) == 2 and len({r.anchor_row for r in got}) == 2 and {r.positive_id for r in got} == {51}


def test_scores_by_subset_sums():
    rng = np.random.default_rng(1)
    for d in (1, 7, 8, 20, 64):
        for low, high in ((0, 1), (-1, 0), (-256, 256), (-3, 90_000), (-(2**31) + 1, 2**31 - 1)):
            a, c = rng.integers(low, high + 1, (5, d)), rng.integers(low, high + 1, (9, d))
            planes = hard_negatives.planes_of(int(c.min()), int(c.max()))
            want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for x in a] for y in c]
            if max(abs(v) for r in want for v in r) < 2**62:
                got = hard_negatives.scores(hard_negatives.subset_sums(a), hard_negatives.pack(c, planes), float(d) * max(abs(low), high, 1) ** 2)
                assert (got == np.array(want)).all()
