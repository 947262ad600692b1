"""Personal data by candidate gradient boosting, in SQL functions alone.

High-recall generators propose overlapping spans of each kind. Every candidate gets format features (digits,
separators, check digits, letters, neighbours) and context features (words before it). Boosted trees score the
candidates, and a threshold for each kind, calibrated for precision on examples that the trees haven't seen, selects
what is added to the spans that pass the fixed rules. Trees and thresholds are learned from labelled sentences: personal
data of every kind in its usual forms, and numbers and words that look alike but aren't personal. The trees are
evaluated as CASE expressions.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import require, small_side

#: Kinds with rules, in their order, and the rules' patterns. Quantifiers are possessive where giving back
#: can't help, and a match starts where a run starts or the last match ended: the same matches in linear time and flat stack.
BASE_KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # generators without a rule of their own
    "iphone": r"(?<![0-9+(])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3,4}[-. ][0-9]{4}(?![0-9])",
    "mail_at": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,12}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:api[_-]?key|token|secret|password|passwd)[\x20\"']{0,2}[=:][\x20\"']{0,3}[A-Za-z0-9_/+=.-]{5,255}[A-Za-z0-9_/+=]",
}
GATES = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "iphone": "[0-9]{4}", "mail_at": "(?i)[( \\[]at[) \\]]", "ssn": "[0-9]-[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "(?i)key|token|secret|pass"}
FINAL = {"iphone": "phone", "mail_at": "email"}
#: Words before a candidate that speak for each kind, and words that name other numbers.
CUES = {
    "email": "mail|contact|write", "ip": r"\bip\b|host|server|login", "card": "card|visa|master|amex|payment|paid", "phone": "tel|phone|call|fax|mobile|cell|reach",
    "iphone": "tel|phone|call|fax|mobile|cell|reach", "mail_at": "mail|contact|write|reach", "ssn": "ssn|social|security|taxpayer", "iban": "iban|account|transfer|bank|konto", "secret": "",
}
OTHER = "order|invoice|part|item|model|serial|version|isbn|page|section|ref|case|ticket|batch|sku|tracking|lot|code|build|release|chapter|dial|score|result"
AFTER = "[a-z]*[^a-z0-9]{0,4}(?:is|no|number)?[^a-z0-9]{0,6}$"
FEATURES = ("kind", "context", "digits", "valid", "joined", "seps", "length", "mixed", "alike")
EQUAL = (0, 1)  # features without an order


def labelled(kind: str):
    return lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["l"]).alias("gap"), z["h"].alias("hit"), F.right(z["l"], F.lit(24)).alias("before"), F.left(z["r"], F.lit(1)).alias("after"))


def candidates(text: Column) -> Column:
    """All generators' matches in a row: array of (kind, i, gap, hit, before, after); ``gap`` is the length between matches."""
    made = []
    for kind, pattern in PATTERNS.items():
        parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        zipped = F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("l"), hits.alias("h"), F.slice(parts, 2, F.size(hits)).alias("r"))
        row = F.transform(zipped, labelled(kind))
        made.append(F.when(text.rlike(GATES[kind]), row))
    empty = F.expr("cast(array() as array<struct<kind: string, i: int, gap: int, hit: string, before: string, after: string>>)")
    return F.concat(*[F.coalesce(m, empty) for m in made])


def luhn(digits: str) -> str:
    return (
        f"aggregate(sequence(1, length({digits})), 0, (s, k) -> s + (case when k % 2 = 1 then int(substring({digits}, -k, 1)) else "
        f"int(substring('0246813579', int(substring({digits}, -k, 1)) + 1, 1)) end)) % 10 = 0"
    )


def spans(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """A row for each candidate and one with a null kind for rows without: ``row_id, id, th, kind, start, stop`` and features."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), candidates(text).alias("c"))
    each = rows.select("row_id", "id", "th", F.explode_outer("c").alias("c")).select("row_id", "id", "th", "c.*")
    each = each.withColumn("stop", F.expr("sum(gap + length(hit)) over (partition by row_id, kind order by i)")).withColumn("start", F.expr("stop - length(hit)"))
    each = each.withColumn("d", F.expr("regexp_replace(hit, '[^0-9]', '')")).withColumn("value", F.expr("case when kind = 'secret' then regexp_replace(hit, '^[^=:]*[=:][ \"\\']*', '') else regexp_replace(hit, '[^A-Za-z0-9]', '') end"))
    octets = "forall(split(hit, '[.]'), o -> length(ltrim('0', o)) <= 3 and coalesce(try_cast(nullif(ltrim('0', o), '') as int), 0) <= 255)"
    rule = F.expr(
        f"case kind when 'email' then true when 'ip' then {octets} when 'card' then length(d) between 12 and 19 and {luhn('d')} "
        "when 'phone' then length(d) between 9 and 15 else false end"
    )
    return each.select(
        "row_id", "id", "th", "kind", "start", "stop", F.coalesce(rule, F.lit(False)).alias("base"),
        F.expr("case when length(d) < 4 then 0 when length(d) < 9 then 1 when length(d) < 12 then 2 when length(d) < 16 then 3 when length(d) < 20 then 4 else 5 end").alias("digits"),
        # the format's own evidence: check digits, octets, plausible groups, mixed characters
        F.expr(
            f"int(coalesce(case kind when 'ip' then {octets} when 'card' then length(d) between 12 and 19 and {luhn('d')} when 'phone' then length(d) between 9 and 15 "
            "when 'iphone' then left(d, 1) not in ('0', '1') when 'ssn' then left(d, 3) not in ('000', '666') and substring(d, 4, 2) <> '00' and right(d, 4) <> '0000' "
            "when 'iban' then length(regexp_replace(hit, ' ', '')) between 15 and 34 and length(d) >= 8 when 'secret' then length(d) >= 2 else true end, false))"
        ).alias("valid"),
        F.expr("case " + " ".join(f"when kind = '{k}' and before rlike r'(?i)(?:{c}){AFTER}' then 1" for k, c in CUES.items() if c) + f" when before rlike r'(?i)(?:{OTHER}){AFTER}' then 2 else 0 end").alias("context"),
        (F.col("before").rlike(r"[\p{L}\p{N}]$") | F.col("after").rlike(r"^[\p{L}\p{N}]")).cast("int").alias("joined"),
        F.expr("least(4, length(regexp_replace(hit, '[A-Za-z0-9]', '')))").alias("seps"),
        F.expr("least(6, int(length(hit) / 6))").alias("length"),
        F.expr("int(value rlike '[0-9]') + 2 * int(value rlike '[a-z]') + 4 * int(value rlike '[A-Z]')").alias("mixed"),
        F.expr("int(size(array_distinct(split(value, ''))) <= 2)").alias("alike"),
    )


def examples(n: int = 2400, seed: int = 3) -> list[tuple[int, str, list[list]]]:
    """Labelled sentences (number, text, spans (kind, start, stop)), made by rule: each holds one item, personal or not."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k, a="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(a) for _ in range(k))
    word = lambda: letters(r.randint(2, 9))
    filler = lambda k: " ".join(word() for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + digits(14)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(body))
        return body + str(-total % 10)

    def grouped(x: str, sep: str, k: int = 4) -> str:
        return sep.join(x[i : i + k] for i in range(0, len(x), k))

    def local() -> str:
        a, b, c = r.choice("23456789") + digits(2), r.choice("23456789") + digits(2), digits(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"))

    iban = lambda: letters(2, "ABCDEFGHIKLMNPRST") + digits(2) + r.choice((digits(16), letters(4, "ABCDEFG") + digits(14)))
    ssn = lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    key = lambda: r.choice((letters(r.randint(16, 48), "0123456789abcdef"), letters(r.randint(12, 40), "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), letters(r.randint(8, 14), "abcdefgh") + digits(3)))
    name = lambda: r.choice(("api_key", "api-key", "apikey", "token", "secret", "password", "passwd", "Token", "API_KEY", "PASSWORD"))
    cue = lambda *xs: r.choice(xs) + r.choice((" ", ": ", " is ", " no. ", " number "))
    other = lambda: cue("order", "invoice", "part", "model", "serial", "version", "ISBN", "page", "ref", "ticket", "batch", "SKU", "tracking", "lot", "code", "build")
    free = lambda: r.choice(("", "", filler(1) + " "))
    yes = {
        "email": lambda: (r.choice((free(), cue("mail", "contact"))), f"{word()}.{word()}@{word()}.{r.choice(('com', 'org', 'de'))}"),
        "ip": lambda: (r.choice((free(), cue("ip", "host"))), ".".join(str(r.randint(1, 255)) for _ in range(4))),
        "card": lambda: (r.choice((free(), cue("card", "visa"))), r.choice((card(), grouped(card(), " "), grouped(card(), "-")))),
        "phone": lambda: (r.choice((free(), cue("call", "phone"))), f"+{r.randint(1, 99)} {local()}"),
        "iphone": lambda: (r.choice((free(), cue("call", "tel", "phone", "fax", "mobile"), cue("call", "tel", "phone", "fax", "mobile"))), local()),
        "mail_at": lambda: (r.choice((free(), cue("mail", "contact", "write"))), r.choice((f"{word()} [at] {word()} [dot] {r.choice(('com', 'org'))}", f"{word()}(at){word()}(dot)com", f"{word()}{digits(2)} at {word()} dot com"))),
        "ssn": lambda: (r.choice((cue("SSN", "social security"), cue("ssn"), free())), ssn()),
        "iban": lambda: (r.choice((cue("IBAN", "account", "transfer"), free())), r.choice((str, lambda x: grouped(x, " ")))(iban())),
        "secret": lambda: (free(), f"{name()}{r.choice(('=', ': ', ' = ', ':'))}{r.choice(('', chr(34), chr(39)))}{key()}"),
    }
    no = {
        "ip": lambda: (other(), f"{r.randint(256, 999)}.{digits(3)}.{digits(1)}.{digits(3)}"),
        "card": lambda: (r.choice((other(), free())), r.choice((digits(13), digits(16), digits(18), grouped(digits(16), " ")))),
        "phone": lambda: (free(), f"+{digits(3)} {digits(2)}"),
        "iphone": lambda: (r.choice((other(), other(), cue("score", "result"))), local()),
        "mail_at": lambda: (r.choice(("meet ", "sold ", "look ", free())), f"{word()} at {word()} dot {word()}"),
        "ssn": lambda: (r.choice((other(), other(), free())), r.choice((ssn(), f"000-{digits(2)}-{digits(4)}"))),
        "iban": lambda: (other(), letters(2, "ABCDEFGHIKLMNPRST") + digits(2) + " " + grouped(r.choice((letters(8, "ABCDEFGHKLM"), digits(8), letters(12, "ABCDEFGHKLM0123"))), " ")),
        "secret": lambda: (free(), f"{name()}{r.choice((': ', ' = ', '='))}{r.choice((word() + letters(4), 'required', 'optional', 'your_password', '........', 'undefined', 'getToken', 'none.given', '1234567', 'example', 'os.environ', 'xxxxxxxx', 'string', 'request.headers'))}"),
    }
    rows = []
    for i in range(n):
        truth = r.random() < 0.5
        kind = r.choice(list(yes if truth else no))
        lead, item = (yes if truth else no)[kind]()
        head = filler(r.randint(0, 5))
        head = f"{head} {lead}" if head else lead
        rows.append((i, head + item + r.choice((" ", ", ", ". ", "\n")) + filler(r.randint(1, 5)), [[kind, len(head), len(head) + len(item)]] if truth else []))
    return rows


def example_counts(spark: SparkSession) -> list[tuple]:
    """(features, fold, personal, not personal) of the examples' candidates; three folds of four train, the last calibrates and measures."""
    made = json.dumps([{"i": i, "t": t, "s": [f"{k}:{a}:{b}" for k, a, b in s]} for i, t, s in examples()])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<i: long, t: string, s: array<string>>>")).alias("x")).select("x.*")
    found = spans(rows, id_col="i", text_col="t").join(rows.select(F.col("i").alias("id"), "s"), "id").where("kind is not null")
    hit = found.withColumn("y", F.expr("int(exists(s, v -> v = concat_ws(':', kind, start, stop)))")).withColumn("fold", F.expr("int(id % 4 = 3)"))
    counted = hit.groupBy("fold", *FEATURES).agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()  # as many as examples at most
    return sorted(((tuple(r[c] for c in FEATURES), r["fold"], float(r["p"]), float(r["n"] - r["p"])) for r in counted), key=str)


def holds(test: tuple, x: tuple) -> bool:
    return x[test[0]] == test[1] if test[2] else x[test[0]] <= test[1]


def grow(table: list[tuple[tuple, float, float]], *, rounds: int = 30, rate: float = 0.4, leaf: float = 2.0) -> tuple[list, float]:
    """Boosted depth-two trees over (features, positives, negatives) rows: a list of trees, and the start score.

    Each tree is (test, (test, a, b), (test, a, b)); a test (feature, value, equal) asks for equality or <=.
    """
    pos, neg = sum(r[1] for r in table), sum(r[2] for r in table)
    base = math.log((pos + 1) / (neg + 1))
    f = [base] * len(table)
    tests = sorted({(j, r[0][j], j in EQUAL) for r in table for j in range(len(FEATURES))}, key=str)
    yes_of = {t: [holds(t, x[0]) for x in table] for t in tests}

    def split(rows, g, h):
        best = (-1.0, None, 0.0, 0.0)
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for t in tests:
            yes = [i for i in rows if yes_of[t][i]]
            if 0 < len(yes) < len(rows):
                gy, hy = sum(g[i] for i in yes), sum(h[i] for i in yes)
                gain = gy * gy / (hy + leaf) + (gs - gy) ** 2 / (hs - hy + leaf)
                if gain > best[0] + 1e-9:
                    best = (gain, t, rate * gy / (hy + leaf), rate * (gs - gy) / (hs - hy + leaf))
        if best[1] is None:
            v = rate * gs / (hs + leaf) if rows else 0.0
            return (tests[0], v, v)
        return best[1:]

    trees = []
    for _ in range(rounds if tests else 0):
        p = [1 / (1 + math.exp(-x)) for x in f]
        g = [r[1] * (1 - q) - r[2] * q for r, q in zip(table, p)]
        h = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(table, p)]
        every = range(len(table))
        top = split(every, g, h)[0]
        yes = [i for i in every if yes_of[top][i]]
        no = [i for i in every if not yes_of[top][i]]
        a, b = split(yes, g, h), split(no, g, h)
        for rows, s in ((yes, a), (no, b)):
            for i in rows:
                f[i] += s[1] if yes_of[s[0]][i] else s[2]
        trees.append((top, a, b))
    return trees, base


def condition(test: tuple) -> str:
    name, value = FEATURES[test[0]], test[1]
    return f"{name} {'=' if test[2] else '<='} {value!r}"


def score_sql(trees: list, base: float) -> str:
    """The model as one SQL expression: a probability."""
    leaf = lambda s: f"(case when {condition(s[0])} then {s[1]!r}D else {s[2]!r}D end)"
    inner = " + ".join([repr(base) + "D"] + [f"(case when {condition(t)} then {leaf(a)} else {leaf(b)} end)" for t, a, b in trees])
    return f"1D / (1D + exp(-({inner})))"


def score_of(x: tuple, trees: list, base: float) -> float:
    for t, a, b in trees:
        s = a if holds(t, x) else b
        base += s[1] if holds(s[0], x) else s[2]
    return 1 / (1 + math.exp(-base))


def calibrate(table: list, trees: list, base: float, precision: float) -> dict[str, float]:
    """For each kind the least score from which on at least ``precision`` of the examples are personal; a kind without one isn't added."""
    cuts = {}
    for kind in PATTERNS:
        scored = sorted(((score_of(r[0], trees, base), r[1], r[2]) for r in table if r[0][0] == kind), reverse=True)
        pos = total = 0.0
        for i, (s, p, n) in enumerate(scored):
            pos, total = pos + p, total + p + n
            if (i + 1 == len(scored) or scored[i + 1][0] < s) and total and pos / total >= precision:
                cuts[kind] = s
    return cuts


def fit(spark: SparkSession, *, precision: float = 0.97) -> tuple[list, float, dict[str, float], list]:
    """Trees, start score, thresholds, and the examples that they were calibrated on."""
    table = example_counts(spark)
    trees, base = grow([(x, p, n) for x, fold, p, n in table if not fold])
    unseen = [(x, p, n) for x, fold, p, n in table if fold]
    return trees, base, calibrate(unseen, trees, base, precision), unseen


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.97) -> DataFrame:
    """One row per row of ``docs``: ``id, text_hash, base, spans``, arrays of (start, ord, kind, stop) by start, then kind.

    Offsets are code points, ends exclusive. ``base`` holds the rules' spans, ``spans`` these and the candidates whose
    score reaches their kind's threshold. Null and empty texts have no spans; null ids and repeated rows keep their
    rows; extra columns are ignored; an empty table gives no rows. Text is scanned once; only candidates are shuffled.
    """
    require(docs, id_col, text_col)
    trees, start, cuts, _ = fit(docs.sparkSession, precision=precision)
    kept = spans(docs, id_col=id_col, text_col=text_col).withColumn("score", F.when(F.col("kind").isNotNull() & ~F.col("base"), F.expr(score_sql(trees, start))))
    order = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(BASE_KINDS)) + " else 9 end"
    final = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in FINAL.items()) + " else kind end"
    enough = " or ".join(f"(kind = '{k}' and score >= {c!r}D)" for k, c in cuts.items()) or "false"
    kept = kept.withColumn("added", F.expr(f"not base and kind is not null and ({enough})")).withColumn("kind", F.expr(final)).withColumn("ord", F.expr(order))
    span = "struct(start, ord, kind, stop)"
    return kept.groupBy("row_id").agg(
        F.first("id").alias(id_col), F.first("th").alias("text_hash"),
        F.expr(f"array_sort(collect_list(case when base and kind is not null then {span} end))").alias("base"),
        F.expr(f"array_sort(array_distinct(collect_list(case when base or added then {span} end)))").alias("spans"),
    ).drop("row_id")


def joined(spans_col: str) -> str:
    return f"array_join(transform({spans_col}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind of the rules' spans, their hash, and all spans as text; a row for each row of ``found``, none for an empty table. Without spans the hash is that of the empty text."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(id_col, *counts, F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in capitals, as in <EMAIL>; columns unchanged. Overlapping spans become one.

    Null and empty texts stay as they are, as do null ids; rows of one id and text are all redacted; an empty table stays empty.
    ``found`` is a stored result of ``detect``, as it is measured; up to 16 MB of spans are broadcast.
    """
    hit = found.where("size(spans) > 0").select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__th"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__th"])
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th"))
    both = docs.join(small_side(hit, "64 + 48 * size(__spans)"), on, "left")
    walk = (
        f"aggregate(__spans, struct('' as out, 0L as at), (a, s) -> case when s.start >= a.at then struct(concat(a.out, substring({text_col}, int(a.at) + 1, int(s.start - a.at)), '<', upper(s.kind), '>') as out, s.stop as at) "
        f"else struct(a.out as out, greatest(a.at, s.stop) as at) end, a -> concat(a.out, substring({text_col}, int(a.at) + 1)))"
    )
    new = F.when(F.col("__spans").isNotNull(), F.expr(walk)).otherwise(F.col(text_col))
    return both.withColumn(text_col, new).select(*docs.columns)
