"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions only.

A candidate is a run of 16 or more characters of keys and tokens; or six or more non-blanks that a name like
`password`, `api_key` or `AUTH_TOKEN` sets by `=`, `=>` or `:`; or the password of a url's `user:password@`. The name and its sign are
no part of it. Its features are its length, mix of characters, changes between kinds of characters, share of frequent letter pairs,
how much of it words of a small dictionary cover, whether it lies in a path, and the words before it. A random forest over
these, trained on labelled findings, gives the share of trees that call it a secret.

The forest is small and fixed in size: it is trained on the driver from a bounded table of labelled texts (made by the rule
in `labelled_findings`, candidates and features taken by the same column expressions that scan) and becomes one column expression. Scanning is a
projection of each row by itself: no join, no shuffle, no state, whatever source or group a document belongs to.

Defined cases: NULL and empty texts have no candidate; a candidate that occurs several times is a finding at each place; an unquoted
value ends at a blank, quote, comma, semicolon, angle bracket, the `&` before a next parameter or its ninth `&`, and holds no closing `.`, `:` or
bracket; a quoted one ends at the quote; a password in a url holds no `/`; a text of many findings takes time by its length and the findings;
repeated rows give repeated findings; an empty table gives an empty result; other columns stay as they are in `redacted`
and are ignored in `findings`.
"""

from __future__ import annotations

import base64 as b64
import hashlib
import random
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base

RUN = r"A-Za-z0-9+/_\-"
#: A name that says secret, the sign that sets its value, and a scheme before the value.
NAME = (
    r"(?i:s(?:ecret|igning)|p(?:assw|wd|assphrase|rivate.?key)|token|a(?:pi.?key|ccess.?key|uth)|bearer|c(?:redential|lient.?key))"
    r"[\w\-]{0,24}[\"'`]?"
)
SIGN = r"(?:=>?(?:[ \t]{1,3}(?=[\"'`]))?|:[ \t]{0,3}|[ \t]{1,3}(?:=>?|:)[ \t]{0,3})"
SET = NAME + SIGN + r"(?:(?i:bearer|basic|token)[ \t]{1,3})?"
QUOTED = r"[\"'`](?!=)[^\s\"'`]{6,}+(?=[\"'`])"
_PLAIN = r"[^\s\"'`<>,;&]"
_AND = r"&(?![A-Za-z_][\w.\-]{0,32}=)"
UNQUOTED = rf"(?!=)(?:{_PLAIN}{{6,}}|{_PLAIN}{{1,5}}{_AND}{_PLAIN}+)(?:{_AND}{_PLAIN}+){{0,8}}(?<![.:)\]}}])"
USER = r"://[^\s:/@\"']*+:"
VALUE = rf"{SET}(?:{QUOTED}|{UNQUOTED})"
#: What scanning takes out of a text: a set value, a url's password, or a run that is no part of a name with a value.
CANDIDATE = (
    rf"{VALUE}|{USER}[^\s/@\"']{{4,}}+(?=@)"
    rf"|(?<![{RUN}])(?=[{RUN}]{{16}})(?![{RUN}]*?{VALUE})[{RUN}]{{16,}}+(?!=[{RUN}])={{0,2}}+"
)
#: The part of such a match that is not the candidate itself.
PREFIX = rf"^(?:{SET}[\"'`]?(?=[^\s\"'`=])|{USER})"
# Frequent letter pairs of Western European prose.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic "
    "ne ea ra ce li ch ll be ma si om ur ei ie sc un ge au qu ue os la ci ai nt tr pa il ss et us ut di so el em da"
).split()
# Words of code, documents and placeholders.
DICTIONARY = (
    "access account action address admin alpha amazon api app application archive article asset author auth back base "
    "beta blog build bucket cache change class client cloud code com commit common config container content control "
    "copy core count country create current customer data date default delete demo detail dev device digest doc "
    "document domain download dummy edit email enable end entity error event example factory feature field file filter "
    "first folder format frame from function general get global group handle hash head here home host html http https "
    "identifier image import index info input install interface internal item java json key label language last layout "
    "left length library license line link list local location log login main manager map master member message meta "
    "method mobile mock model module name net network news next node note null number object office online open option "
    "order org output package page param parent part password path payment phone place placeholder platform plugin port "
    "post private process product profile project property provider public query random read record region release "
    "remote replace report request resource response result return right role root row sample schema script search "
    "secret section select server service session set setting share site size source space staging standard start state "
    "static status storage store string style submit system table tag target task team temp template test text theme "
    "this time title token tool total type update upload url user util value version video view virtual web widget "
    "window with word work world write your"
).split()
# Words before a secret, and words before other long identifiers.
LEADS = "token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|client.?key|signing"
OTHERS = "sha|md5|commit|revision|checksum|digest|integrity|etag|uuid|guid|build|hash|fingerprint|trace|example|order"
FEATURES = (
    "length", "digits", "uppers", "hex", "changes", "pairs", "covered", "distinct", "slashes", "in_path", "lead", "other",
    "assigned", "quoted", "dashes", "symbols", "userinfo",
)


@dataclass(frozen=True)
class Settings:
    """Production parameters; `labelled` bounds the training table."""

    labelled: int = 3_000
    trees: int = 15
    depth: int = 7
    least_leaf: int = 4
    tried: int = 5
    threshold: float = 0.5
    mask: str = "[secret]"


def features(candidate: Column, before: Column, after: Column) -> dict[str, Column]:
    """The candidate's features as numbers between 0 and 1, but for its length."""
    size = F.length(candidate)
    share = lambda pattern: F.length(F.regexp_replace(candidate, pattern, "")) / size
    lower = F.lower(candidate)
    kinds = F.translate(
        candidate, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-", "a" * 26 + "A" * 26 + "0" * 10 + "+" * 5
    )
    # Patterns pass over a candidate once, however long it is.
    changes = F.length(F.regexp_replace(kinds, r"(.)\1*+", "x")) - 1
    pairs = F.regexp_count(lower, F.lit(f"(?={'|'.join(PAIRS)})"))
    words = sorted(DICTIONARY, key=lambda w: (-len(w), w))
    uncovered = F.length(F.regexp_replace(lower, "|".join(words), ""))
    near = F.lower(F.right(before, F.lit(40)))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": size.cast("double"),
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "hex": flag(F.rlike(candidate, F.lit("^([0-9a-f]+|[0-9A-F]+)$"))),
        "changes": changes / size,
        "pairs": pairs / size,
        "covered": 1.0 - uncovered / size,
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / size,
        "slashes": share("[^/]"),
        "in_path": flag(F.rlike(near, F.lit(r"(://|www\.|[/.~])[^ \n\t\"']*$"))),
        "lead": flag(F.rlike(near, F.lit(f"({LEADS})[^a-z]{{0,12}}(is|for|of)?[^a-z]{{0,4}}$"))),
        "other": flag(F.rlike(near, F.lit(f"({OTHERS})[^\n]{{0,12}}$"))),
        "assigned": flag(F.rlike(near, F.lit(r"[=:]>?\s*[\"'`]?$"))),
        "quoted": flag(F.rlike(near, F.lit("[\"'`]$")) & F.rlike(after, F.lit("^[\"'`]"))),
        "dashes": share("[^_-]"),
        "symbols": share("[A-Za-z0-9+/=_-]"),
        "userinfo": flag(F.rlike(near, F.lit("://[^ \n\t/@]*:$")) & F.startswith(after, F.lit("@"))),
    }


def labelled_findings(count: int) -> list[tuple[str, str | None]]:
    """(text, secret) rows made by rule: texts with one secret and texts with what only looks like one, half each."""
    rng = random.Random(41)
    pick = rng.choice
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda letters, n: "".join(pick(letters) for _ in range(n))
    hexed = lambda n: draw("0123456789abcdef", n)
    raw = lambda n: b64.b64encode(hashlib.sha512(str(rng.random()).encode()).digest()[:n]).decode()
    syllables = [a + b for a in PAIRS for b in ("", "n", "r", "s", "t")]
    word = lambda n: "".join(pick(syllables) for _ in range(n))
    term = lambda: pick(DICTIONARY)
    leet = lambda w: "".join(dict(zip("aeiost", "431057")).get(c, c) if rng.random() < 0.7 else c for c in w)
    passwords = [
        lambda: leet(word(3)).capitalize() + pick("!?#$%&*+-_@.") + draw(alnum, rng.randint(1, 4)),
        lambda: word(2).capitalize() + draw("0123456789", rng.randint(2, 4)) + pick(["", "!", "#", "$x", "&7"]),
        lambda: draw(alnum + "0123456789", rng.randint(8, 15)), lambda: draw(alnum + "!#$%&*+-_@?^~", rng.randint(8, 18)),
        lambda: leet(word(2)) + pick("!#$%&*") + draw("0123456789", rng.randint(1, 3)), lambda: hexed(pick([8, 10, 12])),
    ]
    secrets = [
        lambda: hexed(pick([32, 40, 40, 48, 64])), lambda: raw(pick([18, 24, 32, 48])), lambda: draw(alnum, rng.randint(20, 64)),
        lambda: "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + draw(alnum, 36),
        lambda: "sk_live_" + draw(alnum, 24), lambda: "xoxb-" + draw("0123456789", 12) + "-" + draw(alnum, 24),
        lambda: "eyJ" + raw(30).replace("/", "_"), lambda: draw(alnum + "_-", rng.randint(20, 44)),
    ]
    leads = [
        ('token = "', '"'), ("token: ", "\n"), ('api_key="', '"'), ("API-KEY: ", " "), ("secret=", "&"), ("password = '", "'"),
        ("Authorization: Bearer ", "\n"), ("access_key = ", " "), ('"client_secret": "', '",'), ("auth_token=", "\n"),
        ("private key is ", " "), ('signing secret "', '"'), ("export SERVICE_ACCESS_KEY=", "\n"), ("API_TOKEN=", "\n"), ("?auth_token=", "&page=2"),
    ]
    short = [
        ('password = "', '"'), ("pwd: ", "\n"), ("api_key: ", " "), ("DB_PASSWORD=", "\n"), ('"passwd": "', '",'), ("secret = '", "'"),
        ("?token=", "&page=2"), ("password: ", " "), ("client_key => ", " "), ("passphrase: ", "\n"),
    ]
    sites = [("postgres://admin:", "@db.host/x"), ("https://user:", "@example.org/"), ("redis://:", "@cache:6379"), ("amqp://svc:", "@mq")]
    bare = [(" ", " "), ("the ", " of"), ('"', '"'), ("x ", "\n"), ("(", ")")]
    strong = secrets[3:8]

    def positive() -> tuple[str, str | None]:
        if rng.random() < 0.4:
            (before, after), secret = pick(short + sites), pick(passwords)()
        else:
            made = pick(secrets)
            before, after = pick(bare) if made in strong and rng.random() < 0.4 else pick(leads)
            secret = made()
        return (word(2) + " " + before + secret + after + word(2), secret)

    look_alikes = [
        lambda: (pick(bare), word(rng.randint(6, 14))[: rng.randint(16, 40)]),
        lambda: (pick(bare), word(9).capitalize()),
        lambda: (pick(bare), "".join(term().capitalize() for _ in range(rng.randint(3, 5))).ljust(16, "s")),
        lambda: (pick(bare), "_".join(term() for _ in range(rng.randint(3, 5))).ljust(16, "s")),
        lambda: (pick(bare), "-".join(word(2) for _ in range(rng.randint(3, 6))).ljust(16, "e")),
        lambda: (pick([("https://example.org/", "?"), ("see www.example.com/", " "), ("~/", " "), ("/usr/lib/", ".so")]),
                 "/".join(pick([term(), word(2), hexed(8)]) for _ in range(rng.randint(3, 6))).ljust(16, "a")),
        lambda: (pick([("https://example.org/", " "), ("img src=/static/", ".png")]), pick([hexed(32), hexed(40), raw(18)])),
        lambda: (pick([("commit ", "\n"), ("sha1: ", " "), ('integrity="', '"'), ("md5 checksum ", " "), ("etag: ", "\n"),
                       ("revision ", " "), ("digest ", " ")]), pick([hexed(32), hexed(40), hexed(64), raw(48)])),
        lambda: (pick([("uuid ", " "), ("id=", "&"), ("guid: ", " "), ("trace ", " ")]),
                 "-".join(hexed(n) for n in (8, 4, 4, 4, 12))),
        lambda: (pick([*bare, ("order ", " "), ("tel ", " "), ("card ", " ")]), draw("0123456789", rng.randint(16, 24))),
        lambda: (pick([*bare, *leads]), pick("=-_x*0a".replace("*", "A")) * rng.randint(16, 60)),
        lambda: (pick(leads), pick(["your_api_key_here", "replace-with-your-token", "example_secret_value", "placeholder_password",
                                    "test_access_key_default", "INSERT_YOUR_TOKEN_HERE", "my_private_key_file", "dummy_secret_value"])),
        lambda: (pick(leads), word(rng.randint(6, 10)).ljust(16, "e")),
        lambda: (pick(leads), "_".join(term() for _ in range(4)).ljust(16, "s")),
        lambda: (pick(short), pick([word(3), word(4), term().ljust(6, "s"), word(2).ljust(6, "e") + "-" + word(2), "_".join([term(), term()])])),
        lambda: (pick(short), pick([word(3), term().ljust(6, "s")]).capitalize()),
        lambda: (pick(short), pick(["required", "optional", "string", "********", "xxxxxxxx", "<password>", "changeme", "undefined"])),
        lambda: (pick(short), pick(["$", "${", "%(", "{{"]) + "_".join([term(), term()]) + pick(["", "}"])),
        lambda: (pick(short), ".".join([term(), term()]) + pick(["()", "(x)", "", "[0]"])),
        lambda: (pick(short), draw("0123456789", rng.randint(6, 9))),
        lambda: (pick(sites), pick(["password", "secret", "pass", word(2).ljust(6, "s"), "<password>", "${PASSWORD}", "xxxxx"])),
        lambda: (("author: ", "\n"), word(3).capitalize()), lambda: (("tokens = ", " "), draw("0123456789", 6)),
    ]

    def negative() -> tuple[str, str | None]:
        (before, after), made = pick(look_alikes)()
        return (word(2) + " " + before + made + after + word(2), None)

    return [positive() if i % 2 else negative() for i in range(count)]


@dataclass
class Node:
    """A split on `feature` at `at` (not greater goes left), or a leaf with the share of secrets."""

    share: float
    feature: int = -1
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def expression(self, columns: list[Column]) -> Column:
        if self.left is None:
            return F.lit(self.share)
        return F.when(columns[self.feature] <= self.at, self.left.expression(columns)).otherwise(
            self.right.expression(columns)
        )

    def value(self, row) -> float:
        return self.share if self.left is None else (self.left if row[self.feature] <= self.at else self.right).value(row)


def grow(x: np.ndarray, y: np.ndarray, settings: Settings, rng: np.random.Generator, depth: int = 0) -> Node:
    """A tree by Gini impurity, with a few features tried at each split."""
    node = Node(float(y.mean()))
    if depth >= settings.depth or len(y) < 2 * settings.least_leaf or node.share in (0.0, 1.0):
        return node
    best = (node.share * (1 - node.share) * len(y) - 1e-9, -1, 0.0)
    for f in rng.choice(x.shape[1], min(settings.tried, x.shape[1]), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= settings.least_leaf) & (len(y) - n[:-1] >= settings.least_leaf))
        if not len(ok):
            continue
        a, n_a = ones[ok], n[ok]
        b, n_b = ones[-1] - a, len(y) - n_a
        impurity = a * (1 - a / n_a) + b * (1 - b / n_b)
        i = int(impurity.argmin())
        if impurity[i] < best[0]:
            best = (float(impurity[i]), int(f), float((v[ok[i]] + v[ok[i] + 1]) / 2))
    if best[1] < 0:
        return node
    node.feature, node.at = best[1], best[2]
    low = x[:, node.feature] <= node.at
    node.left = grow(x[low], y[low], settings, rng, depth + 1)
    node.right = grow(x[~low], y[~low], settings, rng, depth + 1)
    return node


def train(rows: list[tuple], settings: Settings = Settings()) -> list[Node]:
    """Trees over bootstrap samples of (features..., label) rows."""
    table = np.array(rows, dtype=float)
    rng = np.random.default_rng(17)
    out = []
    for _ in range(settings.trees):
        own = table[rng.integers(0, len(table), len(table))]
        out.append(grow(own[:, :-1], own[:, -1], settings, rng))
    return out


def training_rows(spark: SparkSession, findings: list[tuple[str, str | None]]) -> list[tuple]:
    """Features and label of every candidate that scanning finds in the labelled texts."""
    rows = measured(spark.createDataFrame(findings, "text string, secret string"))
    rows = rows.select("secret", F.explode("_measured").alias("m"))
    right = F.coalesce(F.col("m.candidate") == F.col("secret"), F.lit(False)).cast("int")
    return [tuple(r) for r in rows.select(*(f"m.{f}" for f in FEATURES), right.alias("label")).collect()]


@cache
def _forest(spark: SparkSession, settings: Settings) -> tuple[Node, ...]:
    return tuple(train(training_rows(spark, labelled_findings(settings.labelled)), settings))


def measured(documents: DataFrame) -> DataFrame:
    """The rows with `_gaps`, the texts between matches, and `_measured`: each match's prefix, candidate and features."""
    text = base.text_of()
    has = F.rlike(text, F.lit(CANDIDATE))
    none = F.array().cast("array<string>")

    def cut(match: Column) -> Column:
        prefix = F.regexp_extract(match, PREFIX, 0)
        return F.struct(prefix.alias("prefix"), F.substring(match, F.length(prefix) + 1, F.length(match)).alias("candidate"))

    def with_features(x: Column, i: Column) -> Column:
        gap = F.get("_gaps", i)
        # What was found before still stands before the next one.
        earlier = F.when(i > 0, F.right(F.get("_cut", i - 1)["candidate"], F.lit(40))).otherwise("")
        made = features(x["candidate"], F.concat(earlier, F.right(gap, F.lit(40)), x["prefix"]), F.get("_gaps", i + 1))
        return F.struct(
            x["prefix"].alias("prefix"), x["candidate"].alias("candidate"), (F.length(gap) + F.length(x["prefix"])).cast("long").alias("skipped"),
            *(made[f].alias(f) for f in FEATURES),
        )

    return documents.withColumns({
        "_gaps": F.when(has, F.split(text, CANDIDATE)).otherwise(none),
        "_all": F.when(has, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(none),
    }).withColumn("_cut", F.transform("_all", cut)).withColumn("_measured", F.transform("_cut", with_features)).drop("_all", "_cut")


def scanned(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows with `_gaps` and `_found`: texts between matches, and (prefix, candidate, skipped, score) of each match."""
    forest = _forest(documents.sparkSession, settings)

    def scored(x: Column) -> Column:
        trees = [tree.expression([x[f] for f in FEATURES]) for tree in forest]
        return F.struct(
            x["prefix"].alias("prefix"), x["candidate"].alias("candidate"), x["skipped"].alias("skipped"),
            F.round(reduce(Column.__add__, trees) / len(trees), 6).alias("score"),
        )

    return measured(documents).withColumn("_found", F.transform("_measured", scored)).drop("_measured")


KEPT = "array<struct<start: bigint, length: bigint, secret_sha256: string, score: double>>"


def findings(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per finding that the forest keeps: its place in the text, length, digest and score."""

    def placed(state: Column, x: Column) -> Column:
        start = state["at"] + x["skipped"]
        size = F.length(x["candidate"]).cast("long")
        # The secret itself goes no further than the text it stands in.
        row = F.struct(
            start.alias("start"), size.alias("length"), F.sha2(x["candidate"], 256).alias("secret_sha256"), x["score"].alias("score")
        )
        kept = F.when(x["score"] >= settings.threshold, F.concat(state["kept"], F.array(row).cast(KEPT))).otherwise(state["kept"])
        return F.struct((start + size).alias("at"), kept.alias("kept"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(KEPT).alias("kept"))
    rows = scanned(documents.select("doc_id", "text"), settings)
    # An outer explode: of an inner one Spark would infer a filter that scans every text a second time.
    rows = rows.select("doc_id", F.explode_outer(F.aggregate("_found", begin, placed, lambda s: s["kept"])).alias("f"))
    return rows.where(F.col("f").isNotNull()).select("doc_id", "f.*")


def redacted(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All documents with their columns; kept findings are masked in the text and the length follows."""
    columns = documents.columns
    parts = F.transform(
        "_found", lambda x, i: F.concat(
            F.get("_gaps", i), x["prefix"], F.when(x["score"] >= settings.threshold, F.lit(settings.mask)).otherwise(x["candidate"])
        )
    )
    masked = F.concat(F.array_join(parts, ""), F.element_at("_gaps", -1))
    any_kept = F.exists("_found", lambda x: x["score"] >= settings.threshold)
    rows = scanned(documents, settings).withColumn("_hit", any_kept)
    rows = rows.withColumn("text", F.when(F.col("_hit"), masked).otherwise(F.col("text")))
    if "n_chars" in columns:
        length = F.length("text").cast(documents.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col("_hit"), length).otherwise(F.col("n_chars")))
    return rows.select(*columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(base.table(spark, sf_dir, "documents"))
