"""Secret scans: patterns propose, a random forest removes false positives, in DataFrame expressions only.

Findings are values of assignments to names like password or token, whole however long, and tokens of 16 or more
characters; a token inside a value is judged by itself unless the value is a secret. The forest sees length, changes of
character class, dictionary coverage, path marks and the neighbouring words. It is grown on the driver from labelled
findings (by default generated ones: keys of many makes against names, identifiers, paths, versions, checksums and
numbers, with neighbours that help, mislead or say nothing) and turned into a column expression. The words of the
generated findings are not those that the coverage feature knows.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import NO_SPANS, cut, let, located, pieces, total, union, where_seen

#: Names that secrets are assigned to, and forms that are known to be secrets.
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)s?"
ASSIGNED = rf"(?i)(?<![a-z]){NAMES}[\"']?\s*+[:=]\s*+[\"']?([^\s\"',;]{{6,}}+)"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
KNOWN = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[baprs]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{35}$|^sk_live_[0-9a-zA-Z]{16,}$|^-----BEGIN "
KEYWORD_BEFORE = rf"(?i){NAMES}[\"']?\s*[:=]?\s*[\"']?$"
#: Neighbouring words of checksums and identifiers, and of samples.
CHECKSUM_WORDS = r"(?i)\b(?:commit|sha-?(?:1|256|512)?|md5|checksum|digest|etag|hash|revision|uuid|guid|build|rev|fingerprint|id|blob|tree|parent)\W{0,3}$"
SAMPLE_WORDS = r"(?i)\b(?:example|sample|dummy|fake|placeholder|test|demo|your|e\.g\.)\W{0,3}(?:\w+\W{1,3})?$"
#: Common letter groups of several languages; what they cover looks like words.
GROUPS = (
    "tion|ment|ing|the|and|ent|ion|ter|est|ers|ati|hat|ate|all|eth|her|con|res|ver|com|per|int|pro|ist|ess|ble|out|man|son|ght|ick|est|ung|sch|ich|ein|der|die|und|gen|cht|keit|heit|"
    "que|les|des|our|eau|eux|ait|ado|dad|par|aci|ente|ando|user|name|test|data|file|path|class|func|value|index|list|config|default|example|version|build|model|page|http|html|www"
)
FEATURES = ("length", "changes", "coverage", "path", "extension", "digits", "upper", "hexadecimal", "only_digits", "dashed", "keyword", "checksum", "sample", "assigned", "known", "marks", "distinct", "vowels")
#: Words and name parts of the generated findings that are no secrets.
WORDS = (
    "account balance border bridge button calendar camera castle change client color copper corner country cursor delta desert diagram dragon driver editor engine event export field filter flower folder forest format frame garden "
    "handler harbor header helper image insert island journal kernel ladder layout letter library linear manager market memory message mirror module mountain number object option orange output packet parser pattern pencil planet pocket "
    "process profile project queue random record region release remote render report request result river router sample schema screen script search server service session shadow signal silver simple socket source spring status storage "
    "stream string style summer switch symbol system table target thread ticket timer title track trigger update upload vector video view wagon water window winter worker wrapper abfahrt bahnhof brücke garten himmel kirche schule straße "
    "wasser zeitung chemin jardin maison montagne rivière voiture camino ciudad iglesia montaña puente ventana"
).split()
SHORT = "get set is to from by on off add new old has for max min key id of with all run end any not user name".split()


def features(value: Column, before: Column, assigned: Column) -> dict[str, Column]:
    """The forest's inputs, all double."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    kinds = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1++", "$1"))
    number = lambda c: F.when(c, 1.0).otherwise(0.0)
    like = lambda c, p: number(F.regexp_like(c, F.lit(p)))
    share = lambda chars: F.lit(1.0) - F.length(F.translate(value, chars, "")) / n
    return {
        "length": F.log(n), "changes": (runs - 1) / n, "coverage": F.lit(1.0) - F.length(F.regexp_replace(F.lower(value), GROUPS, "")) / n,
        "path": (n - F.length(F.translate(value, "/.", ""))) / F.sqrt(n), "extension": like(value, r"(?:^|/)[\w-]+\.[a-z]{1,4}$|^/|^https?:"), "digits": share("0123456789"), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "hexadecimal": like(value, "^(?:[0-9a-f]++|[0-9A-F]++)$"), "only_digits": like(value, "^[0-9-]++$"), "dashed": like(value, r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[a-z]+(?:[-_][a-z]+)++$"),
        "keyword": like(before, KEYWORD_BEFORE), "checksum": like(before, CHECKSUM_WORDS), "sample": like(before, SAMPLE_WORDS), "assigned": number(assigned), "known": like(value, KNOWN),
        "marks": share("_-+=$@!%^&*#?"), "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)), "vowels": share("aeiouAEIOU"),
    }


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, bool, int]]:
    """Generated (value, text before, assigned, label), half of them secrets."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    letters = lower + upper
    word = lambda: r.choice(WORDS)
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    many = lambda a, b: [word() for _ in range(r.randint(a, b))]
    brief = lambda: r.choice(SHORT) if r.random() < 0.4 else word()
    camel = lambda: "".join(w.title() if i else w for i, w in enumerate(brief() for _ in range(r.randint(4, 6))))
    hexa = lambda a, b: some("0123456789abcdef", a, b)
    good = [
        lambda: hexa(32, 64), lambda: hexa(16, 24), lambda: some(letters + digits, 16, 64), lambda: some(letters + digits, 64, 400), lambda: some(letters + digits + "+/", 24, 88) + r.choice(["", "=", "=="]), lambda: some(letters, 16, 70),
        lambda: "AKIA" + some(upper + digits, 16, 16), lambda: "ghp_" + some(letters + digits, 36, 36), lambda: some(letters + digits + "!@#$%^&*", 8, 20), lambda: "ey" + ".".join(some(letters + digits + "-_", 20, 300) for _ in range(3)), lambda: some(upper + digits, 16, 40),
    ]
    bad = [
        lambda: "_".join(many(2, 5)) + r.choice(["", some(digits, 1, 3)]), lambda: "/".join(many(3, 6)) + r.choice(["", "/" + some(digits, 1, 4), "." + some(lower, 2, 3)]), lambda: "/" + "/".join(many(3, 9)), lambda: camel() + r.choice(["", some(digits, 1, 2)]), lambda: "".join(many(2, 4)),
        lambda: some(digits, 16, 24), lambda: "-".join([some(digits, 4, 4), some(digits, 2, 2), some(digits, 2, 2), word(), word()]), lambda: word() + "-" + word() + "-v" + some(digits, 1, 2) + "-" + word(), lambda: "-" * r.randint(16, 40), lambda: "_" * r.randint(16, 40), lambda: "=".join(many(2, 2)),
        lambda: "your_" + word() + "_here", lambda: r.choice("xX*a01") * r.randint(8, 24), lambda: "changeme" + some(digits, 1, 3), lambda: "12345678901234567890"[: r.randint(8, 20)], lambda: "-".join(many(3, 6)), lambda: word() + "." + word() + "." + word(), lambda: word() + some(digits, 0, 2),
    ]
    keyed = ["password=", 'token = "', "api_key: ", "secret=", "Bearer ", "auth_token: '"]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.45:
            out.append((r.choice(good)(), r.choice([word() + " ", word() + " ", "\n", "(", ""]), False, 1))
        else:
            out.append((r.choice(good)(), word() + " " + r.choice(keyed), True, 1))
        kind = r.random()
        if kind < 0.55:
            out.append((r.choice(bad)(), r.choice([word() + " ", "", "\n", '"']), False, 0))
        elif kind < 0.75:
            out.append((r.choice(bad)(), word() + " " + r.choice(keyed), True, 0))
        elif kind < 0.95:
            out.append((r.choice([lambda: hexa(32, 64), lambda: hexa(40, 40), lambda: "-".join(hexa(k, k) for k in (8, 4, 4, 4, 12))])(), word() + " " + r.choice(["commit ", "sha256:", "md5=", "checksum: ", "uuid ", "etag: ", "revision ", "digest: ", "hash "]), False, 0))
        else:
            out.append((r.choice(good[:5])(), r.choice(["example key ", "sample ", "dummy value ", "placeholder: "]), False, 0))
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 6, least: int = 8, seed: int = 5) -> list:
    """A random forest: each tree is a share of secrets, or (feature, limit, tree if <= limit, tree if above)."""
    rng = np.random.default_rng(seed)
    tried = max(2, int(np.sqrt(x.shape[1])) + 1)

    def node(rows: np.ndarray, left: int):
        share = float(y[rows].mean())
        if not left or len(rows) < 2 * least or share in (0.0, 1.0):
            return share
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], tried, replace=False):
            v = np.sort(x[rows, f])
            for limit in np.unique((v[:-1] + v[1:])[np.linspace(0, len(v) - 2, 24).astype(int)] / 2):
                low = x[rows, f] <= limit
                a, b = int(low.sum()), int((~low).sum())
                if a >= least and b >= least:
                    p, q = y[rows[low]].mean(), y[rows[~low]].mean()
                    cost = a * p * (1 - p) + b * q * (1 - q)
                    if cost < best[0]:
                        best = (cost, int(f), float(limit))
        if best[1] < 0:
            return share
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], node(rows[low], left - 1), node(rows[~low], left - 1))

    return [node(rng.integers(0, len(x), len(x)), depth) for _ in range(trees)]


def forest_column(forest: list, x: Column) -> Column:
    """The forest's mean vote as an expression over a struct with FEATURES."""

    def tree(t) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(x[FEATURES[t[0]]] <= t[1], tree(t[2])).otherwise(tree(t[3]))

    return total([tree(t) for t in forest]) / len(forest)


def train(spark, findings: list[tuple[str, str, bool, int]] | DataFrame | None = None, sample: int = 20_000, **params) -> list:
    """Grow the forest from labelled findings (value, before, assigned, label), at most ``sample`` of them."""
    if findings is None:
        findings = labelled_findings()
    if not isinstance(findings, DataFrame):
        findings = spark.createDataFrame(findings, "value string, before string, assigned boolean, label int")
    rows = findings.limit(sample).select(*[c.alias(k) for k, c in features(F.col("value"), F.col("before"), F.col("assigned")).items()], "label").collect()
    if len({r["label"] for r in rows}) < 2:
        return [float(rows[0]["label"]) if rows else 1.0]
    return grow(np.array([[r[f] for f in FEATURES] for r in rows]), np.array([float(r["label"]) for r in rows]), **params)


def scan(docs: DataFrame, findings=None, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """docs with n_findings, n_secrets, secrets (array<struct<start, end>>, code points) and clean_text.

    Null texts stay null and empty texts empty, with no findings. clean_text has each secret replaced by ``mask``;
    texts without secrets are unchanged. Columns that have the names of the new ones are replaced, others are kept.
    Repeated rows are answered alike; empty tables give none.
    """
    forest = train(docs.sparkSession, findings)
    added = ("n_findings", "n_secrets", "secrets", "clean_text")
    base = docs.drop(*added, *[c for c in docs.columns if c.startswith("_sec_")])
    none = F.expr(NO_SPANS)
    text = F.coalesce(F.col("text"), F.lit(""))
    guard = lambda hint, pattern, group=0: F.when(F.regexp_like(text, F.lit(hint)), located(text, pattern, group)).otherwise(none)
    parts = F.col("_sec_parts")
    inside = lambda x, w: F.coalesce(w >= x["end"], F.lit(False))
    ends = lambda spans: F.transform(spans, lambda y: F.struct(y["start"].alias("at"), y["end"].cast("long").alias("w")))

    def vote(x: Column, assigned: bool) -> Column:
        f = lambda before: F.struct(*[c.alias(k) for k, c in features(x["value"], before, F.lit(assigned)).items()])
        score = let(cut(parts, x["start"] - 48, x["start"]), lambda before: let(f(before), lambda s: forest_column(forest, s)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    # spans of one list never overlap, so the last that starts at or before a token is the only one that can hold it
    outside = lambda spans: where_seen(spans, lambda x: x["start"], ends(F.col("_sec_blocks")), lambda x, w: ~inside(x, w))
    same = F.transform("_sec_votes", lambda y: F.struct(y["start"].alias("at"), (y["start"].cast("long") * (1 << 31) + y["end"]).alias("w")))
    held = ends(F.filter("_sec_votes", lambda y: y["score"] >= threshold))
    # a token is answered by a value that is the same, or by a secret that holds it
    left = where_seen(F.col("_sec_tokens"), lambda x: x["start"], same, lambda x, w: ~F.coalesce(w == x["start"].cast("long") * (1 << 31) + x["end"], F.lit(False)))
    left = where_seen(left, lambda x: x["start"], held, lambda x, w: ~inside(x, w))
    found = base.withColumn("_sec_blocks", guard("PRIVATE KEY-----", BLOCK)).withColumn("_sec_named", guard(rf"(?i){NAMES}[\"']?\s*+[:=]", ASSIGNED, 1)).withColumn("_sec_tokens", guard(TOKEN, TOKEN))
    some = F.size("_sec_blocks") + F.size("_sec_named") + F.size("_sec_tokens") > 0
    found = found.withColumn("_sec_parts", F.when(some, pieces(text)))
    found = found.withColumn("_sec_tokens", outside(F.col("_sec_tokens"))).withColumn("_sec_votes", F.transform(outside(F.col("_sec_named")), lambda x: vote(x, True)))
    found = found.withColumn("_sec_found", F.concat("_sec_votes", F.transform(left, lambda x: vote(x, False))))
    plain = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    spans = F.concat(F.transform("_sec_blocks", plain), F.transform(F.filter("_sec_found", lambda x: x["score"] >= threshold), plain))
    found = found.withColumn("n_findings", (F.size("_sec_blocks") + F.size("_sec_found")).cast("long")).withColumn("secrets", union(spans)).withColumn("n_secrets", F.size("secrets").cast("long"))
    gap = lambda x, i: F.concat(cut(parts, F.coalesce(F.get(F.col("secrets"), i - 1)["end"], F.lit(0)), x["start"]), F.lit(mask))
    rest = cut(parts, F.get("secrets", F.size("secrets") - 1)["end"], F.length(text))
    clean = F.array_join(F.concat(F.transform("secrets", gap), F.array(rest)), "")
    return found.withColumn("clean_text", F.when(F.col("n_secrets") > 0, clean).otherwise(F.col("text"))).select(*base.columns, *added)
