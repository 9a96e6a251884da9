"""Personal data by weak supervision, in DataFrame expressions only.

Base spans follow fixed patterns and checks. Wider patterns propose further spans: written-out mail addresses, national
phone numbers, social security numbers, bank accounts, IPv6 addresses, names and street addresses. Over all proposals
five labelers vote yes, no or nothing: the form (check digits, valid parts), gazetteers (mail providers, country codes,
first names, street words, reserved ranges), the words before, the characters beside the span, and whether its digits
look made up. Expectation-maximisation estimates how reliable each labeler is from counts of vote patterns; the
resulting probabilities train a logistic classifier on properties of the span and of its surroundings, most of them
beyond the votes (length, kinds of characters, what stands beside it, company of other spans), and it decides on the
further spans. Base spans stay whatever it says.

Texts are read once; proposals with their votes and properties go to a table in the shared folder. Counts of vote and
property patterns are all that reaches the driver: their number does not grow with the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .native import NO_SPANS, cut, let, located, pieces, total, where_seen

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, with possessive loops (long runs can't make them backtrack) and no starts inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before its pattern is tried.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Gazetteers and words around personal data.
PROVIDERS = r"(?i)(?:gmail|yahoo|outlook|hotmail|icloud|proton|gmx|mail|orange|web|free|example)"
ENDINGS = r"(?i)(?:com|net|org|edu|gov|info|de|fr|es|it|uk|eu|ch|at)$"
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Don|Doña"
FIRST_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Emily|Emma|"
    "Hans|Peter|Wolfgang|Klaus|Jürgen|Stefan|Andreas|Ursula|Monika|Sabine|Petra|Claudia|Jean|Pierre|Michel|Philippe|Nicolas|Marie|Nathalie|Isabelle|Sophie|Camille|"
    "José|Juan|Carlos|Luis|Miguel|Javier|María|Carmen|Lucía|Pilar|Mohammed|Fatima|Wei|Yuki|Olga|Ivan"
)
STREETS = r"Street|St\.|Avenue|Ave\.?|Road|Rd\.?|Lane|Drive|Boulevard|Blvd\.?|Court|Square"
COUNTRIES = r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)"
MADE_UP = r"^(?:078-?05-?1120|219-?09-?9999|123-?45-?6789)$|2001:(?:0?db8|DB8):"
NEAR = r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|reach|write|phone|tel|telefon|call|mobile|cell|fax|whatsapp|ssn|social security|card|visa|karte|tarjeta|carte|iban|account|konto|compte|cuenta|ip|host|server|login|address|adresse|dirección|lives? (?:at|in)|name|signed|regards)[\w]*+\W{0,4}(?:\w+\W+){0,2}$"
AWAY = r"(?i)(?:version|release|isbn|issn|order|invoice|part|model|serial|figure|fig|table|section|chapter|page|doi|ticket|build|rev)[\w.]*+\W{0,4}(?:no\W*)?$"
#: Proposals beyond the base; loops are possessive or bounded by what they describe.
WIDER = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[({](?:at|@)[\])}] ?[a-z0-9-]++(?: ?(?:\.|[\[({](?:dot|\.)[\])}]) ?[a-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])|(?<![0-9A-Za-z+().-])0(?:[ /-]?[0-9]){8,13}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "name": rf"(?=[A-Z])(?<![\w])(?:(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)*+|(?:{FIRST_NAMES})(?: \p{{Lu}}\.)? \p{{Lu}}\p{{Ll}}+)(?![\w])",
    "address": rf"(?<![\w])[0-9]{{1,5}}[a-z]?,? (?:\p{{Lu}}[\w']*+ ){{1,4}}(?:{STREETS})(?![\w])|(?<![\w])\p{{Lu}}\p{{Ll}}*(?:straße|strasse|platz|allee|gasse) [0-9]{{1,4}}[a-z]?(?![\w])|(?<![\w])[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|chemin) (?:de |du |des |la |le |l')*\p{{Lu}}[\w'-]*+|(?<![\w])(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo) (?:de |del |la |los )*\p{{Lu}}[\w'-]*+,? [0-9]{{1,4}}(?![\w])",
}
WIDER_HINT = {
    "email": r"(?i)[\[({](?:at|@)[\])}]", "phone": r"[0-9][.-][0-9]{4}|(?<![0-9])0(?:[ /-]?[0-9]){8}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[ A-Z0-9]", "ipv6": r"[0-9A-Fa-f]:[0-9A-Fa-f:]",
    "name": rf"(?=[A-Z])(?<![\w])(?:{TITLES}|{FIRST_NAMES})\.? \p{{Lu}}", "address": r"[0-9][a-z]?,? [\p{Lu}rabpc]|\p{L},? [0-9]",
}
ORDER = (*KINDS, *(k for k in WIDER if k not in KINDS))
LABELERS = ("form", "gazetteer", "context", "beside", "made_up")
FEATURES = (*(f"is_{k}" for k in ORDER), "short", "long", "letters", "blanks", "brackets", "capital", "line_start", "after_colon", "after_word", "before_stop", "company", "strict", "valid", "invalid", "near", "away")
#: What EM starts from, for each labeler: the chance to vote yes or no on personal data, and on other text.
START = {"form": ((0.6, 0.1), (0.1, 0.5)), "gazetteer": ((0.6, 0.1), (0.1, 0.5)), "context": ((0.5, 0.05), (0.1, 0.4)), "beside": ((0.4, 0.05), (0.1, 0.4)), "made_up": ((0.02, 0.02), (0.02, 0.4))}


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits fits."""
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number's check digits fit: letters count from 10, the first four characters go last."""
    flat = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4)), "")
    step = lambda a, c: F.when(F.regexp_like(c, F.lit("[0-9]")), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def passes(kind: str, value: Column) -> Column:
    """The check that a base match must pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, r"^0++(?=[0-9])", "")), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    found = F.filter(located(text, BASE[kind]), lambda x: passes(kind, x["value"]))
    return F.when(F.regexp_like(text, F.lit(HINT[kind])), found).otherwise(F.expr(NO_SPANS))


def proposals(text: Column, kind: str) -> Column:
    return F.when(F.regexp_like(text, F.lit(WIDER_HINT[kind])), located(text, WIDER[kind])).otherwise(F.expr(NO_SPANS))


def described(x: Column, kind: str, strict: bool, parts: Column, company: Column) -> Column:
    """The span with its votes and properties: v has a base-3 digit for each labeler, f a bit for each of FEATURES."""
    value = x["value"]
    like = lambda c, p: F.regexp_like(c, F.lit(p))

    def told(before: Column, after: Column) -> Column:
        prev = F.right(before, F.lit(1))
        form = {
            "email": (like(value, r"[A-Za-z]"), like(value, r"^[.-]|\.\.")), "ip": (F.lit(True), F.lit(False)), "card": (F.lit(True), F.lit(False)),
            "phone": (F.lit(strict) | like(value, r"^\(?[2-9]|^0[1-9]"), like(value, r"^\(?[01][0-9]{2}[).-]")), "ssn": (F.lit(True), like(value, r"^(?:000|666|9[0-9]{2})|-00-|-0000$")),
            "iban": (mod97(value), ~mod97(value)), "ipv6": (like(value, r"[A-Fa-f]|:.*:.*:"), like(value, r"^[0-9]{1,2}:(?::?[0-9]{1,2})+$")),
            "name": (like(value, rf"^(?:{TITLES})\.? "), F.lit(False)), "address": (like(value, "[0-9]"), F.lit(False)),
        }[kind]
        listed = {
            "email": (like(value, PROVIDERS) | like(value, ENDINGS), ~like(value, PROVIDERS) & ~like(value, ENDINGS)), "phone": (like(value, r"^\+|^\(?[2-9][0-8][0-9]\)?[ .-]?[2-9]|^0[1-9]"), like(value, r"[.-]555[.-]01")),
            "ssn": (F.lit(False), like(value, MADE_UP)), "ip": (F.lit(False), like(value, r"^0\.|^127\.|^255\.|\.0\.0\.0$")), "card": (like(value, r"^[3-6]"), like(value, r"^[0789]")),
            "iban": (like(value, COUNTRIES), ~like(value, COUNTRIES)), "ipv6": (like(value, "^2[0-9a-fA-F]{3}:|^f[de]"), like(value, MADE_UP)), "name": (like(value, rf"(?:{FIRST_NAMES})\b"), F.lit(False)), "address": (F.lit(True), F.lit(False)),
        }[kind]
        digits = F.regexp_replace(value, "[^0-9]", "")
        votes = (
            form, listed, (like(before, NEAR) & ~like(before, AWAY), like(before, AWAY)), (like(prev, r"^[:(<\[]?$|\s") & like(after, r"^$|[\s.,;)>\]]"), like(prev, r"[\w#/=.]") | like(after, r"[\w/=]")),
            (F.lit(False), like(value, MADE_UP) | like(digits, r"^(\d)\1{6,}$|^0?123456789?0?")),
        )
        flags = {
            f"is_{kind}": F.lit(True), "short": F.length(value) < 12, "long": F.length(value) > 24, "letters": like(value, r"\p{L}{3}"), "blanks": like(value, " "), "brackets": like(value, r"[()\[\]{}]"), "capital": like(value, r"\p{Lu}"),
            "line_start": like(prev, r"^$|\n"), "after_colon": like(before, r"[:=] ?$"), "after_word": like(before, r"\p{L} $"), "before_stop": like(after, r"^$|[.,;\n]"), "company": company, "strict": F.lit(strict),
            "valid": votes[0][0] & ~votes[0][1], "invalid": votes[0][1], "near": votes[2][0], "away": votes[2][1],
        }
        v = sum((F.when(yes & ~no, 1).when(no, 2).otherwise(0) * 3**i for i, (yes, no) in enumerate(votes)), F.lit(0))
        f = sum((F.when(flags[n], 1 << i).otherwise(0) for i, n in enumerate(FEATURES) if n in flags), F.lit(0))
        return F.struct(x["start"].alias("start"), F.lit(ORDER.index(kind)).alias("kind"), x["end"].alias("end"), v.cast("int").alias("v"), f.cast("int").alias("f"))

    return let(cut(parts, x["start"] - 48, x["start"]), lambda before: let(cut(parts, x["end"], x["end"] + 1), lambda after: told(before, after)))


NONE_TOLD = "cast(array() as array<struct<start:int,kind:int,end:int,v:int,f:int>>)"


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, and ``base`` and ``more``: described spans; more ones touch no base span."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("*", *[matches(F.col("text"), k).alias(f"b_{k}") for k in KINDS], *[proposals(F.col("text"), k).alias(f"w_{k}") for k in WIDER])
    n_base, n_more = total([F.size(f"b_{k}") for k in KINDS]), total([F.size(f"w_{k}") for k in WIDER])
    rows = rows.select("*", n_base.cast("int").alias("n_base"), n_more.cast("int").alias("n_more"))
    rows = rows.select("*", F.when(F.col("n_base") + F.col("n_more") > 0, pieces(F.col("text"))).alias("p"))
    company = F.col("n_base") + F.col("n_more") > 1

    def told(kind: str, strict: bool):
        return lambda x: described(x, kind, strict, F.col("p"), company)

    marks = F.concat(*[F.transform(f"b_{k}", lambda x: F.struct(x["start"].alias("at"), x["end"].cast("long").alias("w"))) for k in KINDS])
    apart = lambda k: where_seen(F.col(f"w_{k}"), lambda x: x["end"] - 1, F.col("marks"), lambda x, w: F.coalesce(w <= x["start"], F.lit(True)))
    rows = rows.withColumn("marks", marks)
    base = F.when(F.col("n_base") > 0, F.concat(*[F.transform(f"b_{k}", told(k, True)) for k in KINDS])).otherwise(F.expr(NONE_TOLD))
    more = F.when(F.col("n_more") > 0, F.concat(*[F.transform(apart(k), told(k, False)) for k in WIDER])).otherwise(F.expr(NONE_TOLD))
    return rows.select("doc_id", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), more.alias("more"))


def reliabilities(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Probability that spans of each vote pattern are personal data, by expectation-maximisation."""
    if not counts:
        return {}
    codes, n = np.array(sorted(counts)), np.array([counts[v] for v in sorted(counts)], float)
    votes = np.array([[v // 3**i % 3 for i in range(len(LABELERS))] for v in codes])  # 0 nothing, 1 yes, 2 no
    rate = np.array([[[1 - sum(START[name][c]), *START[name][c]] for c in (0, 1)] for name in LABELERS])
    start, prior = rate.copy(), 0.5

    def chance() -> np.ndarray:
        like = np.stack([np.prod([rate[i, c, votes[:, i]] for i in range(len(LABELERS))], axis=0) for c in (0, 1)])
        a, b = prior * like[0], (1 - prior) * like[1]
        return a / (a + b)

    for _ in range(rounds):
        p = chance()
        prior = min(0.98, max(0.02, float((p * n).sum() / n.sum())))
        for i in range(len(LABELERS)):
            for c, weight in ((0, p * n), (1, (1 - p) * n)):
                # two imagined spans that vote as at the start keep the classes' meaning
                got = np.bincount(votes[:, i], weight, 3) + 2 * start[i, c]
                rate[i, c] = got / got.sum()
    return dict(zip(codes.tolist(), chance().tolist(), strict=True))


def classifier(f: np.ndarray, p: np.ndarray, n: np.ndarray, steps: int = 600, l2: float = 0.01) -> np.ndarray:
    """Logistic weights (bias first) from feature masks, probabilities and counts."""
    x = np.column_stack([np.ones(len(f)), *((f >> i) & 1 for i in range(len(FEATURES)))]).astype(float)
    w, share = np.zeros(x.shape[1]), n / max(1.0, n.sum())
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - p) * share
        w -= x.T @ r + l2 * np.append(0.0, w[1:])
    return w


def find_pii(docs: DataFrame, threshold: float = 0.6, rounds: int = 50) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans.

    Null and empty texts have no spans. Positions are code points, ends exclusive; spans are joined in order of start,
    then kind (email, ip, card, phone, ssn, iban, ipv6, name, address). Further spans of different kinds may overlap.
    Repeated rows are answered alike, extra columns are ignored, empty tables give none. Without proposals nothing is
    learnt and nothing added. ``rounds`` 0 takes the labelers' starting reliabilities as they are.
    """
    found = Scratch(docs.sparkSession).save(with_spans(docs))
    counts = found.select(F.explode(F.concat("base", "more")).alias("x")).groupBy("x.v", "x.f").agg(F.count("*").alias("n")).collect()
    votes: dict[int, int] = {}
    for r in counts:
        votes[r["v"]] = votes.get(r["v"], 0) + r["n"]
    chance = reliabilities(votes, rounds)
    order = sorted(counts)
    w = classifier(np.array([r["f"] for r in order], int), np.array([chance[r["v"]] for r in order]), np.array([r["n"] for r in order], float))

    def likely(x: Column) -> Column:
        z = total([F.lit(float(w[0])), *[F.when(x["f"].bitwiseAND(F.lit(1 << i)) != 0, F.lit(float(v))).otherwise(F.lit(0.0)) for i, v in enumerate(w[1:])]])
        return z >= float(np.log(threshold / (1 - threshold)))

    names = F.array(*[F.lit(k) for k in ORDER])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    out = found.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.filter("more", likely).alias("more"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "more")).alias("spans"), (F.size("base") + F.size("more")).cast("long").alias("n_spans"))
