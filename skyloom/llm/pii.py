"""Personal data by weak supervision. DataFrame functions only.

Patterns propose spans. Five labelers vote on each (+1 personal, -1 not, 0 no opinion): form, gazetteer, words
before it, its borders, and its variety of characters. Expectation-maximisation on the counts of vote patterns
estimates how reliable each labeler is and how probable each pattern; a logistic span classifier is trained on
these probabilities and sees votes and the span's own shape. Spans of the four base kinds that pass their checks
stay whatever it says; spans of the other kinds are added if it accepts them.

The driver handles the table of patterns only: kinds x votes x shapes, which has a fixed bound.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .store import written

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "local_phone", "national_id", "iban", "person")
KINDS = BASE + ADDED
VOTES = ("form", "gazetteer", "context", "border", "variety")
EM_ROUNDS, FIT_ROUNDS, ACCEPT = 30, 400, 0.5
CONTEXT = 24

#: Patterns. Possessive forms and look-behinds only save backtracking; what they find is the same.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TITLES = r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? "
#: Two searches, so that a number and a run of letters and digits that overlap don't hide one another.
_NUMBERS = (
    r"\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){13,18}+(?![0-9])"
    r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?<![0-9(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
)
_RUNS = (
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+"
    rf"|{_TITLES}\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"
)
#: Gazetteers and words of contexts, as patterns.
_DOMAINS = r"\.(com|org|net|edu|gov|io|info|de|fr|es|uk|it|nl|eu|ch|at)$"
_CALLING = r"^\+(1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
_ISSUERS = r"^(4|5[1-5]|2[2-7]|34|37|6011|65|35)"
_WORDS = {
    "email": "e-?mail|mail|contact|write",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|tel|call|mobile|fax",
    "secret": "token|key|secret|passw|pwd|auth|api",
    "local_phone": "phone|tel|call|mobile|fax",
    "national_id": "ssn|social|security|id",
    "iban": "iban|account|bank|konto",
    "person": "name|by|from|dear|contact|signed",
}


def _lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """Evaluate `value` once and name it in `body`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _found(pattern: str, gate: str) -> str:
    """SQL for array<struct<s, e, m, pre, post>>: all matches of a pattern in column t, leftmost first, with code point offsets.

    Matches are marked in the text, the text is cut at the marks, and the lengths of the pieces are summed, in
    groups of 256 so that the work is linear in the number of matches but for a small square.
    """
    none = "cast(array() AS array<struct<s: bigint, e: bigint, m: string, pre: string, post: string>>)"
    sums = "transform(sequence(0, (size(lens) - 1) div 256), g -> aggregate(slice(lens, g * 256 + 1, 256), 0L, (a, x) -> a + x))"
    inner = (
        "aggregate(slice(lens, g * 256 + 1, 256), named_struct('p', aggregate(slice(sums, 1, g), 0L, (a, x) -> a + x), 'out', cast(array() AS array<bigint>)), "
        "(a, x) -> named_struct('p', a.p + x, 'out', array_append(a.out, a.p))).out"
    )
    starts = f"flatten(transform(sequence(0, (size(lens) - 1) div 256), g -> {inner}))"
    each = _let(
        "m",
        "substring_index(p, '\\u0002', 1)",
        f"named_struct('s', starts[i], 'e', starts[i] + char_length(m), 'm', m, 'pre', right(replace(pieces[i - 1], '\\u0002', ''), {CONTEXT}), 'post', left(substring(p, char_length(m) + 2), 8))",
    )
    body = _let("starts", starts, f"filter(transform(pieces, (p, i) -> CASE WHEN i > 0 THEN {each} END), x -> x IS NOT NULL)")
    body = _let("lens", "transform(pieces, (p, i) -> cast(char_length(p) - IF(i > 0, 1, 0) AS bigint))", _let("sums", sums, body))
    body = _let("pieces", f"split(regexp_replace(t, {_lit(pattern)}, '\\u0001$0\\u0002'), '\\u0001', -1)", f"IF(size(pieces) = 1, {none}, {body})")
    return f"CASE WHEN {gate} THEN {body} ELSE {none} END"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = "aggregate(transform(split(reverse(d), ''), (c, i) -> IF(c = '', 0, IF(i % 2 = 0, int(c), IF(int(c) > 4, 2 * int(c) - 9, 2 * int(c))))), 0, (a, v) -> a + v) % 10 = 0"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '\\\\.'), v -> char_length(ltrim('0', v)) <= 3 AND int(right(v, 3)) <= 255)",
    "card": _let("d", _DIGITS, f"char_length(d) BETWEEN 14 AND 19 AND {_LUHN}"),
    "phone": f"char_length({_DIGITS}) BETWEEN 10 AND 15",
}
_EXTRA_KIND = (
    "CASE WHEN x.m RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' THEN 'national_id' WHEN x.m RLIKE '^[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,4})?$' THEN 'iban' "
    "WHEN x.m RLIKE '^\\\\(?[0-9]{3}\\\\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$' THEN 'local_phone' WHEN x.m RLIKE '^[A-Za-z0-9_/+=-]{20,}$' AND NOT x.m RLIKE '^\\\\+?[0-9-]+$' THEN 'secret' "
    "WHEN x.m RLIKE '^[A-Z][a-z]+\\\\.? \\\\p{Lu}' THEN 'person' END"
)


def _ballot(kind: str) -> str:
    """SQL of the votes and shape of x, of the kind in SQL expression `kind`."""
    form = (
        f"CASE {kind} WHEN 'email' THEN IF(x.m RLIKE '\\\\.[A-Za-z]{{2,}}$', 1, -1) WHEN 'ip' THEN IF(x.m RLIKE '(^|\\\\.)0[0-9]', -1, 1) WHEN 'card' THEN IF(x.m RLIKE '^([0-9]{{13,}}|([0-9]{{4}}[ -]){{3}}[0-9]{{1,7}})$', 1, -1) "
        f"WHEN 'phone' THEN IF(x.m RLIKE '[() .-]', 1, 0) WHEN 'secret' THEN IF(x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]', 1, -1) WHEN 'iban' THEN IF(char_length(regexp_replace(x.m, ' ', '')) BETWEEN 15 AND 34, 1, -1) ELSE 1 END"
    )
    gaz = (
        f"CASE {kind} WHEN 'email' THEN IF(x.m RLIKE {_lit('(?i)' + _DOMAINS)}, 1, 0) WHEN 'ip' THEN IF(x.m RLIKE '^(0|127|255|22[4-9]|2[34][0-9])\\\\.', -1, 1) WHEN 'card' THEN IF(x.m RLIKE {_lit(_ISSUERS)}, 1, 0) "
        f"WHEN 'phone' THEN IF(x.m RLIKE {_lit(_CALLING)}, 1, -1) WHEN 'secret' THEN IF(x.m RLIKE '^([0-9a-fA-F]{{32}}|[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}}|(sk|pk|ghp|AKIA)[A-Za-z0-9_-]+)$', 1, IF(x.m RLIKE '^[A-Za-z]+$', -1, 0)) ELSE 0 END"
    )
    cases = " ".join(f"WHEN '{k}' THEN IF(x.pre RLIKE {_lit('(?i)(' + w + ')')}, 1, 0)" for k, w in _WORDS.items())
    border = "IF(x.pre RLIKE '[\\\\p{L}0-9]$' OR x.post RLIKE '^[\\\\p{L}0-9]', -1, 1)"
    variety = "CASE WHEN size(array_distinct(split(regexp_replace(x.m, '[^A-Za-z0-9]', ''), ''))) <= 3 THEN -1 WHEN char_length(x.m) > 64 THEN -1 ELSE 0 END"
    share = "char_length(regexp_replace(x.m, '[^0-9]', '')) / char_length(x.m)"
    return (
        f"'form', {form}, 'gazetteer', {gaz}, 'context', CASE {kind} {cases} ELSE 0 END, 'border', {border}, 'variety', {variety}, "
        f"'long', CASE WHEN char_length(x.m) < 12 THEN 0 WHEN char_length(x.m) < 24 THEN 1 WHEN char_length(x.m) < 48 THEN 2 ELSE 3 END, 'digits', CASE WHEN {share} < 0.1 THEN 0 WHEN {share} < 0.7 THEN 1 ELSE 2 END"
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all proposed spans of each row with votes and shapes; texts aren't kept."""
    marks = F.expr(f"IF(instr({text_col}, '\\u0001') > 0 OR instr({text_col}, '\\u0002') > 0, translate({text_col}, '\\u0001\\u0002', '\\u0003\\u0003'), coalesce({text_col}, ''))")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias(text_col)).select("doc_id", marks.alias("t"))
    src = src.select("doc_id", "t", F.expr("t RLIKE '[0-9]'").alias("digit"))
    rows = src.select(
        "doc_id",
        F.expr(_found(_EMAIL, "instr(t, '@') > 0")).alias("email"),
        F.expr(_found(_IP, "digit AND instr(t, '.') > 0")).alias("ip"),
        F.expr(_found(_CARD, "digit")).alias("card"),
        F.expr(_found(_PHONE, "digit AND instr(t, '+') > 0")).alias("phone"),
        F.expr(_found(_NUMBERS, "digit")).alias("numbers"),
        F.expr(_found(_RUNS, f"digit OR t RLIKE {_lit(_TITLES)}")).alias("runs"),
    )
    parts = [f"transform(filter({k}, x -> {_VALID[k]}), x -> named_struct('s', x.s, 'k', {i}, 'e', x.e, {_ballot(_lit(k))}))" for i, k in enumerate(BASE)]
    number = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    ballot = _let("kind", _EXTRA_KIND, f"IF(kind IS NULL, NULL, named_struct('s', x.s, 'k', {number}, 'e', x.e, {_ballot('kind')}))")
    parts += [f"filter(transform({c}, x -> {ballot}), x -> x IS NOT NULL)" for c in ("numbers", "runs")]
    return rows.select("doc_id", F.expr(f"array_sort(concat({', '.join(parts)}))").alias("spans"))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]]) -> tuple[dict[int, float], dict[int, list[float]], list[float]]:
    """EM on (kind, votes, count): each kind's share of true spans, each labeler's accuracy on each kind, each pattern's probability.

    A labeler's accuracy on a kind is drawn to its accuracy on all kinds as if that had been seen in 10 votes.
    """
    prior, right = {k: 0.7 for k, _, _ in patterns}, {k: [0.8] * len(VOTES) for k, _, _ in patterns}
    prob = [0.0] * len(patterns)
    for _ in range(EM_ROUNDS):
        for i, (k, v, _) in enumerate(patterns):
            prob[i] = _sigmoid(math.log(prior[k] / (1 - prior[k])) + sum(x * math.log(r / (1 - r)) for x, r in zip(v, right[k])))
        for j in range(len(VOTES)):
            cast, agree = dict.fromkeys(prior, 0.0), dict.fromkeys(prior, 0.0)
            for (k, v, n), p in zip(patterns, prob):
                if v[j]:
                    cast[k] += n
                    agree[k] += n * (p if v[j] > 0 else 1 - p)
            pooled = (sum(agree.values()) + 8) / (sum(cast.values()) + 10)
            for k in prior:
                right[k][j] = min(0.98, max(0.55, (agree[k] + 10 * pooled) / (cast[k] + 10)))
        for k in prior:
            total = sum(n for q, _, n in patterns if q == k)
            prior[k] = min(0.98, max(0.02, (sum(n * p for (q, _, n), p in zip(patterns, prob) if q == k) + 1) / (total + 2)))
    return prior, right, prob


def _vector(kind: int, votes, long: int, digits: int) -> list[float]:
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *map(float, votes), *[float(long == x) for x in range(4)], *[float(digits == x) for x in range(3)]]


def fit_classifier(rows: list[tuple[int, tuple[int, ...], int, int, int]]) -> list[float]:
    """Weights of the span classifier from (kind, votes, long, digits, count)."""
    counts: dict[tuple[int, tuple[int, ...]], int] = {}
    for k, v, _, _, n in rows:
        counts[k, v] = counts.get((k, v), 0) + n
    patterns = sorted((k, v, n) for (k, v), n in counts.items())
    target = {(k, v): p for (k, v, _), p in zip(patterns, reliabilities(patterns)[2])}
    data = [(_vector(k, v, a, d), target[k, v], math.sqrt(n)) for k, v, a, d, n in sorted(rows)]
    w, total = [0.0] * len(_vector(0, (0,) * len(VOTES), 0, 0)), sum(n for _, _, n in data)
    for _ in range(FIT_ROUNDS if data else 0):
        grad = [1e-3 * x for x in w]
        for x, y, n in data:
            miss = (_sigmoid(sum(a * b for a, b in zip(w, x))) - y) * n / total
            for j, a in enumerate(x):
                if a:
                    grad[j] += miss * a
        w = [a - 1.0 * g for a, g in zip(w, grad)]
    return w


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, personal) for each row.

    spans lists kind:start:end of all spans by start, then kind in the order of KINDS; offsets are code points,
    end exclusive; base_sha256 is the hash of the base spans so listed. n_added counts the spans of other kinds;
    personal: any span was found. Null and empty texts have none.
    Repeated rows stay repeated; other columns are not read; an empty table gives no rows.
    """
    found = written(candidates(docs, id_col, text_col), "spans")
    each = found.select(F.explode("spans").alias("x")).groupBy("x.k", *[f"x.{v}" for v in VOTES], "x.long", "x.digits").count().collect()
    w = fit_classifier([(r.k, tuple(r[v] for v in VOTES), r.long, r.digits, r["count"]) for r in each])
    at = 1 + len(KINDS)
    terms = [f"{w[0]!r}D", "element_at(array(" + ", ".join(f"{v!r}D" for v in w[1:at]) + "), x.k + 1)", *[f"{w[at + j]!r}D * x.{v}" for j, v in enumerate(VOTES)]]
    at += len(VOTES)
    terms += ["element_at(array(" + ", ".join(f"{v!r}D" for v in w[at : at + 4]) + "), x.long + 1)", "element_at(array(" + ", ".join(f"{v!r}D" for v in w[at + 4 : at + 7]) + "), x.digits + 1)"]
    taken = f"filter(spans, x -> x.k < {len(BASE)} OR {' + '.join(terms)} >= {math.log(ACCEPT / (1 - ACCEPT))!r}D)"
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    listed = "array_join(transform({}, x -> concat(element_at(" + names + ", x.k + 1), ':', x.s, ':', x.e)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.k = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    base = listed.format(f"filter(spans, x -> x.k < {len(BASE)})")
    return found.withColumn("taken", F.expr(taken)).select(
        F.col("doc_id").cast("long").alias("doc_id"), *counts, F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(listed.format("taken")).alias("spans"),
        F.expr(f"cast(size(filter(taken, x -> x.k >= {len(BASE)})) AS bigint)").alias("n_added"),
        F.expr("size(taken) > 0").alias("personal"),
    )
