"""Personal data: base spans against plain patterns, the weak supervision
against simulated labelers."""

import hashlib
import random
import re
import time

import numpy as np

from trailframe.llm import pii, queries
from trailframe.llm.common import table

SF = "/root/testdata/sf0.001"


def luhn(d):
    return sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def base(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN)
                   for m in re.finditer(p, text or "") if ok(m.group()))
    joined = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in found)
    return (*[sum(k == j for _, k, _ in found) for j in range(4)], hashlib.sha256(joined.encode()).hexdigest())


def got(df):
    return [(r.doc_id, (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in df.collect()]


def run(df, **kw):
    spans, model = pii.personal_data(df, **kw)
    return pii.digests(spans), model


def test_whole_table(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert sorted(got(queries.op11_personal_data(spark, SF))) == sorted((r.doc_id, base(r.text)) for r in docs)


def test_base_spans_on_odd_texts(spark):
    """The linear patterns match what the plain ones do."""
    rng = random.Random(3)
    parts = ["a", "b1", "@", ".", "com", "x-y", "_", "+", "1", "22", "255", "256", "0", " ", "-", "(", ")", "é", "\U0001f600",
             "4111111111111111", "4111 1111 1111 1111", "+1 (988) 555-2485", "1.2.3.4", "me@a.bc", "\n", "%", "[at]", " at ", " dot "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    texts += ["a@b.c_x@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "001.002.003.004", "+12", "+123456789012", "", None,
              "+1234567890-", "5.5.5." + "9" * 400, "\U0001f600" * 5 + "a@b.c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.c"), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id long, text string, spans string, kind int").repartition(3)
    out, _ = run(df)
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got(out), key=key) == sorted(((i, base(t)) for i, t in rows), key=key)


def test_long_texts_take_linear_time(spark):
    rows = [(1, "a" * 1_000_000), (2, "1 " * 300_000), (3, "a.b" * 200_000 + "@"), (4, "9" * 400_000 + "." * 400_000),
            (5, "me@a.bc, " * 20_000), (6, "a@" + "b." * 200_000 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    started = time.time()
    out = dict(got(run(df)[0]))
    assert time.time() - started < 120
    assert out[5][0] == 20_000 and out[6][0] == 1
    assert out[5] == base(rows[4][1]) and out[2] == base(rows[1][1])


def test_empty_table(spark):
    out, model = run(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and model["kinds"] == []


def test_expectation_maximisation_finds_the_reliabilities():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.55])
    says = np.where(rng.random((truth.size, 6)) < right, truth[:, None], ~truth[:, None])
    votes = np.where(rng.random((truth.size, 6)) < 0.2, 1, np.where(says, 2, 0))
    patterns, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rates = pii.reliabilities(np.column_stack([patterns, n]), np.zeros(len(n), bool))
    guess = post[inverse.ravel()] >= 0.5
    assert (guess == truth).mean() > 0.95
    assert (guess == truth).mean() >= ((votes - 1).sum(axis=1) > 0).astype(bool).__eq__(truth).mean()
    for k in range(5):  # P(1 | true) / P(1 or -1 | true)
        assert abs(rates[1, k, 2] / (rates[1, k, 0] + rates[1, k, 2]) - right[k]) < 0.03


def test_classifier_weights_are_the_optimum():
    rng = np.random.default_rng(2)
    bits, n, p = np.arange(1 << pii.FEATURES), rng.integers(1, 50, 1 << pii.FEATURES).astype(float), rng.random(1 << pii.FEATURES)
    w = pii.logistic(bits, n, p)
    x = np.column_stack([np.ones(bits.size)] + [(bits >> i) & 1 for i in range(pii.FEATURES)])
    slope = x.T @ (n * (p - 1 / (1 + np.exp(-x @ w)))) - np.r_[1e-6, np.ones(pii.FEATURES)] * w
    assert np.abs(slope).max() < 1e-6


def test_method_adds_spans(spark):
    """Written-out addresses and numbers with a telling context are added;
    version numbers, order numbers and hashes are not; base spans stay."""
    good, bad = [], []
    for i in range(60):
        good += [f"write an email to joe{i} (at) mail{i}.com please", f"call my phone 415-555-{1000 + i} now",
                 f"mail ann{i}@mail.com", f"phone +1 415 555 {2000 + i}", f"the server address 10.0.{i}.1"]
        bad += [f"see version 4.3.{i}.999 here", f"order 1234 5678 9012 {3000 + i} came", f"part 123-456-{7000 + i}x there"]
    rows = list(enumerate(good + bad))
    spans, model = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r.doc_id: r for r in pii.digests(spans).collect()}
    texts = dict(rows)
    added = {i: r.spans for i, r in out.items() if r.n_added}
    assert not [texts[i] for i in added if i >= len(good)]
    for i, t in rows:
        if "(at)" in t or "415-" in t:
            kind, a, b = out[i].spans.split(":")
            cut = texts[i][int(a):int(b)]
            assert cut == (t[18:-7] if "(at)" in t else t[14:26]) and kind in ("email", "phone")
    assert model["kinds"] == ["card", "email", "ip", "phone"]


def test_main_path_has_no_python_workers(spark):
    df = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = pii.candidates(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Python")
