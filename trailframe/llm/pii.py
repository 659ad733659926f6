"""Operator 11: personal data by weak supervision, in Spark expressions only.

* **Base spans** are the valid matches of four strict patterns (e-mail, IPv4
  address, payment card, phone number).  They are always kept.
* **Candidates** are, besides, the strict matches that fail their check, and
  matches of loose patterns in what the strict ones leave (`` at ``/`` dot ``
  addresses, hosts without a dot, defanged and IPv6 addresses, cards with
  unusual separators, numbers without a country code).
* **Labelers** vote -1, 0 or 1 on every candidate: the strict pattern, a
  soundness check, a gazetteer, the words in front, the grouping, the edges.
* **Reliabilities** of the labelers, per kind, come from
  expectation-maximisation over the counts of vote patterns; candidates that
  are base spans are held at 1.
* **The span classifier**, a logistic regression per kind over binary
  features of the span, is trained on the posteriors of all candidates and
  decides which of them are added.

Spark finds, votes, counts and scores.  What reaches the driver is one row
per kind and vote pattern (at most 4 x 3^6) and one per kind and feature
pattern (at most 4 x 2^9), whatever the size of the corpus.  A text's spans
stay in its row, so nothing is joined or grouped by document; positions are
running sums in two levels, so a long text costs little more than its length.

Strict patterns are written with possessive quantifiers and a look-behind.
They match what the plain forms match, in time linear in the text.

Cases: a null text is empty; no candidates at all train nothing and add
nothing; a null ``doc_id`` stays null; repeated rows are scanned once each;
spans of one kind never overlap, those of different kinds may; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.arrays import bind, starts
from trailframe.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: patterns of the base spans, linear forms
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: patterns of further candidates, looked for between the strict matches
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?: ?[(\[{{] ?at ?[)\]}}] ?{_DOMAIN}++(?:(?: ?[(\[{{] ?dot ?[)\]}}] ?|\.){_DOMAIN}++)++"
             rf"| at {_DOMAIN}++(?: dot {_DOMAIN}++)++|@{_DOMAIN}++)",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9])"
          r"|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./_])",
    "phone": r"(?<![0-9+./-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9./-])"
             r"|(?<![0-9+./-])00[ -]?[1-9][0-9](?:[ .-]?+[0-9]){6,11}+(?![0-9])",
}
#: what a text must hold for either to match
NEEDS = {
    "email": (r"@", r"@|[(\[{] ?at ?[)\]}]| dot "),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]", r"[\])][0-9]{1,3}[\[(]\.|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "card": (r"[0-9][ -]?[0-9]", r"[0-9]{4}[./_][0-9]{4}"),
    "phone": (r"\+[0-9]", r"[0-9]{3}[ .-][0-9]{4}|00[ -]?[1-9][0-9]"),
}
#: gazetteers: top-level domains, first digits of card issuers, country codes; fixed values
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|ai|co|me|app|dev|eu|de|fr|es|it|nl|be|at|ch|uk|ie|pt|pl|se|no|dk|fi|us|ca|mx|br|ar|au|nz|jp|cn|in|ru"
ISSUERS = "4|5[1-5]|2[2-7]|3[4-9]|6011|62|64|65"
COUNTRIES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: words in front of a span that speak for its kind; fixed values
CONTEXT = {
    "email": r"e-?mail|mail|contact|write|correo|kontakt|courriel|address",
    "ip": r"\bip\b|address|server|host|adresse|login|connect",
    "card": r"card|visa|master|amex|credit|pay|tarjeta|karte|carte",
    "phone": r"phone|call|tel|fax|mobile|cell|contact|llam|anruf|appel",
}
#: words in front of a span that speak against any kind; fixed values
AGAINST = r"version|release|section|chapter|isbn|issn|order|invoice|ticket|serial|part|page|\bno\b|#|\bid\b"
LEFT = 40
VOTES = 6
#: presumed rates of the votes -1, 0, 1 on what is personal data
PRESUMED = (0.15, 0.25, 0.6)
FEATURES = 9


def _piece(text: Column, kind: int) -> Column:
    return F.struct(text.alias("s"), F.lit(kind).alias("t"))


def _pieces(text: Column, kind: str) -> Column:
    """The text cut into plain pieces (t = 0), loose (1) and strict (2)
    matches, in order."""
    need, need_loose = NEEDS[kind]

    def cut(s, pattern, between, hit):
        return F.flatten(F.zip_with(F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), 0), lambda g, h: F.when(
            h.isNull(), between(g)).otherwise(F.concat(between(g), F.array(_piece(h, hit))))))

    def loose(s):
        plain = F.array(_piece(s, 0))
        return F.when(s.rlike(need_loose), cut(s, LOOSE[kind], lambda g: F.array(_piece(g, 0)), 1)).otherwise(plain)

    return F.when(text.rlike(need), cut(text, STRICT[kind], loose, 2)).otherwise(loose(text))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _judged(kind: str, c: Column) -> Column:
    """The candidate with its votes (base 3) and features (bits)."""
    s, t, left = c["s"], c["t"], F.lower(c["left"])
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(digits)
    octets = F.forall(F.filter(F.split(s, "[^0-9]+"), lambda x: x != ""), lambda x: x.cast("double") <= 255)
    if kind == "email":
        valid = F.lit(True)
        sound = s.rlike(r"[A-Za-z]{2,24}$")
        known = s.rlike(rf"(?i)(?:\.| dot |[)\]}}] ?)(?:{DOMAINS})$")
        grouped = s.rlike(r"^[^@]*[A-Za-z]")
    elif kind == "ip":
        valid = sound = octets
        known = s.rlike(r"^(?:10|172|192|127|1[0-9]{2}|[1-9][0-9]?|2[01][0-9]|22[0-3])[^0-9]|:")
        grouped = s.rlike(r"^[0-9]{1,3}(?:[^0-9:]+[0-9]{1,3}){3}$|:")
    elif kind == "card":
        valid = n.between(14, 19) & F.when(n.between(14, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
        sound = n.between(13, 19) & F.when(n.between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
        known = digits.rlike(f"^(?:{ISSUERS})")
        grouped = s.rlike(r"^(?:[0-9]{4}[^0-9]?){3}[0-9]{1,7}$|^[0-9]{4}[^0-9][0-9]{6}[^0-9][0-9]{4,5}$|^[0-9]{14,19}$")
    else:
        valid = n.between(10, 15)
        sound = n.between(7, 15) & ~digits.rlike(r"^([0-9])\1*$")
        known = s.rlike(rf"^(?:\+|00[ -]?)(?:{COUNTRIES})") | s.rlike(r"^\(?[2-9][0-9]{2}[^0-9]")
        grouped = s.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^\+?[0-9]{1,4}[ ().-]+[0-9].*[ .-]")
    strict = t == 2
    base = strict & valid
    for_it, against = left.rlike(CONTEXT[kind]), left.rlike(AGAINST)
    edges = ~F.concat(F.right(c["left"], F.lit(1)), c["right"]).rlike(r"[\p{L}\p{N}]")
    votes = [_vote(base, strict), _vote(sound, ~sound), _vote(known, ~known),
             _vote(for_it & ~against, against & ~for_it), _vote(grouped, ~grouped), _vote(edges, ~edges)]
    features = [strict, sound, known, for_it, against, grouped, edges, n >= 10, F.length(s) > 24]
    assert len(votes) == VOTES and len(features) == FEATURES
    code = sum(((v + 1) * 3 ** i for i, v in enumerate(votes)), F.lit(0))
    bits = sum((f.cast("int") * (1 << i) for i, f in enumerate(features)), F.lit(0))
    return F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["end"].alias("end"),
                    base.alias("base"), code.cast("int").alias("votes"), bits.cast("int").alias("bits"))


def _candidates(text: Column, kind: str) -> Column:
    def spans(p):
        def one(at):
            places = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: p[i]["t"] > 0)
            return F.transform(places, lambda i: _judged_at(p, at, i))
        return F.when(F.size(p) > 1, bind(starts(F.transform(p, lambda x: F.char_length(x["s"]))), one)).otherwise(
            F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,votes:int,bits:int>>"))

    def _judged_at(p, at, i):
        none = F.lit("")
        c = F.struct(
            p[i]["s"].alias("s"), p[i]["t"].alias("t"), at[i].alias("start"),
            (at[i] + F.char_length(p[i]["s"])).alias("end"),
            F.when(i > 0, F.right(F.get(p, i - 1)["s"], F.lit(LEFT))).otherwise(none).alias("left"),
            F.coalesce(F.left(F.get(p, i + 1)["s"], F.lit(1)), none).alias("right"))
        return bind(c, lambda x: _judged(kind, x))

    return bind(_pieces(text, kind), spans)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: the judged candidates of each text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.select("doc_id", F.concat(*[_candidates(F.col("text"), k) for k in KINDS]).alias("found"))


def reliabilities(counts: np.ndarray, fixed: np.ndarray, rounds: int = 500, tol: float = 1e-10):
    """Posterior of every vote pattern (a row of ``counts``: votes 0..2, then
    the number of candidates) and the rates ``P(vote | class)`` of the
    labelers, by expectation-maximisation.  ``fixed`` patterns stay at 1.

    Labelers are presumed better than chance: each class starts with the
    rates ``PRESUMED``, worth 20 candidates and a hundredth of all."""
    votes, n = counts[:, :VOTES].astype(int), counts[:, VOTES].astype(float)
    presumed = np.array([PRESUMED[::-1], PRESUMED])
    worth = 20 + n.sum() / 100
    odds = np.log(presumed[1] / presumed[0])[votes].sum(axis=1)
    post = np.where(fixed, 1.0, 1 / (1 + np.exp(-odds)))
    rates = np.zeros((2, VOTES, 3))
    for _ in range(rounds):
        for y, share in ((1, post), (0, 1 - post)):
            for k in range(VOTES):
                rates[y, k] = np.bincount(votes[:, k], weights=n * share, minlength=3) + worth * presumed[y]
        rates /= rates.sum(axis=2, keepdims=True)
        prior = ((n * post).sum() + 1) / (n.sum() + 2)
        odds = np.log(prior / (1 - prior)) + np.log(rates[1, np.arange(VOTES), votes]
                                                    / rates[0, np.arange(VOTES), votes]).sum(axis=1)
        new = np.where(fixed, 1.0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
        moved, post = float(np.abs(new - post).max(initial=0.0)), new
        if moved < tol:
            break
    return post, rates


def logistic(bits: np.ndarray, n: np.ndarray, target: np.ndarray, l2: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights (constant first) of a logistic regression on feature patterns
    seen ``n`` times with the mean label ``target``, by Newton steps."""
    x = np.column_stack([np.ones(bits.size)] + [(bits >> i) & 1 for i in range(FEATURES)]).astype(float)
    w = np.zeros(FEATURES + 1)
    ridge = np.diag([1e-6] + [l2] * FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * np.maximum(p * (1 - p), 1e-9))) @ x + ridge, x.T @ (n * (target - p)) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(found: DataFrame) -> dict:
    """Posteriors by vote pattern, labeler rates and classifier weights of
    every kind, from the candidates of all texts."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.bits", "c.base")
    counts = each.groupBy("kind", "votes", "base").agg(F.count(F.lit(1)).alias("n")).collect()
    post = np.zeros((len(KINDS), 3 ** VOTES))
    rates = {}
    for k, kind in enumerate(KINDS):
        rows = [r for r in counts if r.kind == k]
        if rows:
            table = np.array([[r.votes // 3 ** i % 3 for i in range(VOTES)] + [r.n] for r in rows], np.int64)
            p, rates[kind] = reliabilities(table, np.array([r.base for r in rows]))
            post[k, [r.votes for r in rows]] = p
    known = F.from_json(F.lit(json.dumps(post.tolist())), "array<array<double>>")
    seen = (each.withColumn("p", known[F.col("kind")][F.col("votes")]).groupBy("kind", "bits")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")).collect())
    weights = np.zeros((len(KINDS), FEATURES + 1))
    for k in range(len(KINDS)):
        rows = [r for r in seen if r.kind == k]
        if rows:
            n = np.array([r.n for r in rows], float)
            weights[k] = logistic(np.array([r.bits for r in rows]), n, np.array([r.p for r in rows]) / n)
    return {"posterior": post, "rates": rates, "weights": weights, "kinds": sorted(rates)}


def classify(found: DataFrame, model: dict, min_score: float = 0.5) -> DataFrame:
    """``doc_id, spans``: base spans and the candidates that the classifier
    scores ``min_score`` or more, ``(start, kind, end, base, score)`` in
    order."""
    w = F.from_json(F.lit(json.dumps(model["weights"].tolist())), "array<array<double>>")

    def scored(c):
        own = w[c["kind"]]
        z = sum((own[i + 1] * F.shiftright(c["bits"], i).bitwiseAND(F.lit(1)) for i in range(FEATURES)), own[0])
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"),
                        c["base"].alias("base"), (F.lit(1.0) / (F.exp(-z) + 1)).alias("score"))

    kept = F.filter(F.transform("found", scored), lambda c: c["base"] | (c["score"] >= min_score))
    return found.select("doc_id", F.array_sort(kept).alias("spans"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_score: float = 0.5) -> tuple[DataFrame, dict]:
    """The spans of every text (see :func:`classify`) and the model."""
    found = materialize(candidates(docs, id_col, text_col), "personal")
    model = train(found)
    return classify(found, model, min_score), model


def digests(spans: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans),
    ``base_sha256, spans`` and ``n_added``."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(s):
        return F.array_join(F.transform(s, lambda c: F.concat_ws(
            ":", names[c["kind"]], c["start"].cast("string"), c["end"].cast("string"))), ",")

    def number(k):
        return F.size(F.filter(base, lambda c: c["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    base = F.filter("spans", lambda c: c["base"])
    counts = [number(k) for k in range(len(KINDS))]
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"),
                        (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
