"""Secret scans: long tokens and short named values are candidates, and a random forest removes false positives.

Features: length, character classes and their transitions, dictionary coverage, the likelihood of letter pairs, path
shape and neighbouring words, all native expressions. Dictionary and letter pairs are counted over all documents. The
forest is Spark ML's, fitted on labelled findings: a table (before, candidate, after, label) with the text around
each candidate and 1.0 for a secret. Without findings of your own, ``template_findings`` makes LABELLED ones
from the templates below (a documented bound, independent of the corpus).
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import checkpoint, lower_az

#: The shape of a candidate, and words beside one that name secrets, digests or stand-ins.
_CHAR = "[A-Za-z0-9+/_.-]"
_NAME = r"(?i:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)(?:s|[_-][A-Za-z0-9_-]{0,24})?"
NAMES = _NAME + r"[\"']?\s*(?:=|:|=>|:=)\s*[\"']?$"
DIGESTS = r"(?i)\b(?:commit|sha-?[0-9]*|md5|etag|checksum|digest|hash|revision|rev|blob|tree|uuid|guid|build|version|id|fingerprint|integrity)\b[^A-Za-z0-9]{0,4}(?:of |is |at )?[^A-Za-z0-9]{0,3}$"
STAND_INS = r"(?i)x{4,}|0{8,}|\*{4,}|(?<![a-z0-9])(?:example|sample|dummy|placeholder|change[-_]?me|your[-_]|redacted|insert|todo)|12345678|abcdefgh|environ|getenv|process\.env|secrets\."
#: Tokens of 16 characters and more, and values of any length and punctuation right after a name; "=" parts a name from its value, or pads an end.
_AFTER_NAME = _NAME + r"[\"']?\s{0,16}(?:=|:|=>|:=)\s{0,16}[\"']?"
_FIRST, _VALUE = "[^\\s\"'<>,;`=:(){}\\[\\]]", "[^\\s\"'<>,;`]"
CANDIDATE = rf"(?<!{_CHAR})(?:{_CHAR}{{16,}}+|{_FIRST}(?<=[=:>][\s\"']{{0,17}}{_FIRST})(?<={_AFTER_NAME}{_FIRST}){_VALUE}*+)(?:={{1,2}}+(?![A-Za-z0-9+/_.=\"'-]))?+"
COLUMNS = ("length", "digits", "uppers", "transitions", "distinct", "hex", "coverage", "letter_pairs", "path", "named", "assigned", "quoted", "digest", "stand_in")
#: Bounds: labelled findings, trees and their depth, words of the dictionary (the most frequent of all).
LABELLED, TREES, DEPTH, WORDS = 4000, 40, 8, 5000


@dataclass(frozen=True)
class Lexicon:
    """The most frequent words of a corpus, and log2 P(second | first letter) for the 26 * 26 pairs of letters."""

    words: tuple[str, ...]
    pairs: tuple[float, ...]


@dataclass(frozen=True)
class Scanner:
    """A fitted forest with the lexicon of its features."""

    forest: RandomForestClassificationModel
    lexicon: Lexicon


def learn_lexicon(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> Lexicon:
    """Counts over the lower-cased runs of three and more ASCII letters of all texts; ``words`` and 676 rows reach the driver."""
    runs = F.filter(F.split(lower_az(F.col(text_col)), "[^a-z]+"), lambda w: F.length(w) >= 3)
    counts = checkpoint(docs.select(F.explode(runs).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    top = counts.orderBy(F.desc("n"), "w").limit(words).collect()
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))
    seen = {r["p"]: r["n"] for r in counts.select(F.explode(pairs).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).collect()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    firsts = {x: sum(seen.get(x + y, 0) for y in letters) for x in letters}
    return Lexicon(tuple(sorted(r["w"] for r in top)), tuple(math.log2((seen.get(x + y, 0) + 0.5) / (firsts[x] + 13)) for x in letters for y in letters))


def _coverage(lexicon: Lexicon) -> Column:
    """The share of a candidate's characters in words of the lexicon; words end at other characters and at capitals."""
    listed = ",".join(f"'{w}'" for w in lexicon.words) or "''"
    parted = r"regexp_replace(candidate, '([a-z])([A-Z])', '$1 $2')"
    return F.expr(f"aggregate(split(lower({parted}), '[^a-z]+'), 0, (s, w) -> s + if(w in ({listed}), length(w), 0)) / length(candidate)")


def _letter_pairs(lexicon: Lexicon) -> Column:
    """Mean log2 likelihood of the letter after each letter; 0 where no two letters meet."""
    table = "array(" + ",".join(f"{x:.4f}D" for x in lexicon.pairs) + ")"
    codes = "transform(filter(split(lower(candidate), ''), c -> c <> ''), c -> ascii(c) - 97)"
    step = f"(s, c) -> named_struct('last', c, 'n', s.n + if(s.last between 0 and 25 and c between 0 and 25, 1, 0), 'sum', s.sum + if(s.last between 0 and 25 and c between 0 and 25, get({table}, s.last * 26 + c), 0D))"
    return F.expr(f"aggregate({codes}, named_struct('last', -1, 'n', 0, 'sum', 0D), {step}, s -> if(s.n = 0, 0D, s.sum / s.n))")


def features(lexicon: Lexicon) -> Column:
    """A struct of COLUMNS from the columns candidate, before and after."""
    candidate, before, after = F.col("candidate"), F.col("before"), F.col("after")
    n = F.length(candidate).cast("double")
    less = lambda pattern: (n - F.length(F.regexp_replace(candidate, pattern, ""))) / n
    change = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    values = (
        F.least(n, F.lit(400.0)), less("[0-9]+"), less("[A-Z]+"), (F.size(F.split(candidate, change)) - 1) / n,
        F.size(F.array_distinct(F.split(F.lower(candidate), ""))) / n, F.rlike(candidate, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        _coverage(lexicon), _letter_pairs(lexicon), F.rlike(candidate, F.lit(r"/[A-Za-z_.-]*/|^\.?\.?/|\.[a-z]{2,4}$")),
        F.rlike(before, F.lit(NAMES)), F.rlike(before, F.lit(r"[=:]\s*[\"']?$")), F.rlike(before, F.lit(r"[\"']$")) & F.rlike(after, F.lit(r"^[\"']")),
        F.rlike(before, F.lit(DIGESTS)), F.rlike(candidate, F.lit(STAND_INS)),
    )
    return F.struct(*[v.cast("double").alias(c) for v, c in zip(values, COLUMNS, strict=True)])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", around: int = 40) -> DataFrame:
    """(id, place, candidate, before, after) of every candidate; place is the character offset, from 0, and before and after are of the text around it."""
    text = F.col(text_col)
    # Generated, not filtered: a filter on the findings would be pushed down and search each text again.
    found = F.filter(F.array(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))), lambda m: F.size(m) > 0)
    rows = docs.select(F.col(id_col), text.alias("_text"), F.explode(found).alias("_found"))
    rows = rows.withColumn("_parts", F.split("_text", CANDIDATE, -1))

    def walk(s: Column, i: Column) -> Column:
        part, found = F.get("_parts", i), F.get("_found", i)
        place = s["at"] + F.length(part)
        after = F.substring(F.get("_parts", i + 1), 1, around)
        before = F.right(F.concat(s["tail"], part), F.lit(around))
        row = F.struct(place.alias("place"), found.alias("candidate"), before.alias("before"), after.alias("after"))
        tail = F.right(F.concat(before, found), F.lit(around))
        return F.struct((place + F.length(found)).alias("at"), tail.alias("tail"), F.concat(s["rows"], F.array(row)).alias("rows"))

    empty = F.array().cast("array<struct<place:int,candidate:string,before:string,after:string>>")
    # Chunks of 64 keep the growing arrays short in a text of very many tokens.
    lengths = F.transform("_found", lambda m, i: F.length(F.get("_parts", i)) + F.length(m))
    rows = rows.withColumn("_lengths", lengths).withColumn("_chunks", F.transform(F.sequence(F.lit(0), F.floor((F.size("_found") - 1) / 64).cast("int")), lambda c: c * 64))
    offset = F.aggregate(F.transform("_chunks", lambda c: F.aggregate(F.slice("_lengths", c + 1, 64), F.lit(0), lambda a, x: a + x)), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    rows = rows.withColumn("_offsets", offset)
    # What lies before each chunk, once from the text.
    tails = F.transform("_offsets", lambda at: F.substring(F.col("_text"), F.greatest(at - around, F.lit(0)) + 1, F.least(at, F.lit(around))))
    rows = rows.withColumn("_tails", tails).drop("_text").select("*", F.posexplode("_chunks").alias("_c", "_from"))
    start = F.struct(F.get("_offsets", F.col("_c")).alias("at"), F.get("_tails", F.col("_c")).alias("tail"), empty.alias("rows"))
    last = F.least(F.col("_from") + 63, F.size("_found") - 1)
    walked = F.aggregate(F.sequence(F.col("_from"), last), start, lambda s, i: walk(s, i), lambda s: s["rows"])
    return rows.select(id_col, F.inline(walked))


#: Templates of findings: text before, what the candidate is made of, text after. Secrets first, then what is none.
SECRETS = (
    ('token = "', "hex40", '"'), ("TOKEN=", "base40", "\n"), ("password: ", "short", "\n"), ('password = "', "short", '"'), ("api_key='", "hex32", "'"), ('secret="', "base40", '"'),
    ("access_key = ", "akia", " "), ("API_TOKEN=", "hex40", " "), ("export SERVICE_TOKEN=", "base40", "\n"), ('aws_secret_access_key = "', "base40", '"'), ("db_password: ", "short", " "),
    ("Authorization: Bearer ", "jwt", "\n"), ("the key is ", "jwt", " and"), ("use ", "akia", " for"), ("", "prefixed", " "), ("push with ", "prefixed", "."), ("auth_token: ", "hex64", " "),
    ("private_key: ", "line", "\n"), ("-----BEGIN KEY-----\n", "line", "\n"), ('{"client_secret": "', "base24", '"}'), ("pwd=", "short", "&"), ("credential = ", "base24", ";"), ("access-key: ", "upper40", " "),
)
OTHERS = (
    ("commit ", "hex40", "\n"), ("sha1 of the file: ", "hex40", " "), ("sha256: ", "hex64", "\n"), ("md5 ", "hex32", "  file"), ("checksum = ", "hex64", " "), ('etag: "', "hex32", '"'), ("revision ", "hex40", ","),
    ("id: ", "uuid", " "), ("build ", "number", " "), ("see ", "path", " "), ("http://", "dotted", " "), ("in ", "path", "."), ("the ", "words", " is"), ("", "words", ","), ("| ", "dashes", " |"), ("call ", "camel", "("),
    ('token = "', "stand_in", '"'), ("password: ", "stand_in", "\n"), ("api_key=", "stand_in", " "), ("password: ", "word", "\n"), ("secret = ", "word", " "), ("token: ", "camel", " "), ("the secret: ", "words", " "),
    ("# set ", "key_name", ' = "'), ("", "key_name", ": "), ("passwd: ", "path", " "), ("auth = ", "dotted", "("), ("tree ", "hex40", " "), ("fingerprint: ", "upper40", " "), ("order ", "number", " "), ("integrity=", "hex64", " "),
)
KEY_NAMES = ("aws_secret_access_key", "database_password_production", "SERVICE_ACCOUNT_TOKEN", "production_api_key")
STAND_IN_TEXTS = ("changeme-changeme", "your-token-goes-here", "xxxxxxxxxxxxxxxxxxxx", "EXAMPLE-KEY-0000000000", "os.environ.TOKEN", "placeholder_value_1", "00000000-0000-0000-0000", "insert-password-here")
PREFIXES = ("ghp_", "sk_live_", "xoxb-", "glpat-", "npm_")
COMMON = "house water letter people number market system change report project window garden result history picture station company service message country".split()


def _made(kind: str, i: int) -> str:
    """A text of a kind, drawn by the hash of ``i``."""
    h = hashlib.sha512(f"finding {i}".encode()).hexdigest()
    at = lambda k: int(h[2 * k : 2 * k + 4], 16)
    blob = "".join(base64.b64encode(hashlib.sha512(f"{i} {k}".encode()).digest()).decode().rstrip("=") for k in range(4))
    plain = blob.replace("+", "x").replace("/", "y")
    word = lambda k: COMMON[at(k) % len(COMMON)]
    makers = {
        "hex40": lambda: h[:40], "hex32": lambda: h[:32], "hex64": lambda: h[:64], "upper40": lambda: h[:40].upper(), "base40": lambda: blob[:40], "base24": lambda: plain[:24],
        "akia": lambda: "AKIA" + plain.upper()[:16], "prefixed": lambda: PREFIXES[i % len(PREFIXES)] + plain[: 24 + i % 16], "line": lambda: "MII" + blob[: 60 + i % 280],
        "jwt": lambda: "eyJhbGciOiJIUzI1NiJ9.eyJ" + plain[: 40 + i % 160] + "." + plain[-43:], "short": lambda: (plain[: 8 + i % 8], word(1) + plain[:4] + h[:3], word(1).title() + "!" + plain[:3] + "#" + h[:2])[i % 3],
        "uuid": lambda: "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:32])), "number": lambda: str(int(h[:14], 16)), "path": lambda: ("/usr/share/" if i % 2 else "src/") + "/".join(map(word, range(1 + i % 4))) + "/" + word(9) + ".html",
        "dotted": lambda: ".".join(("www", word(1) + word(2), word(3), "com")), "words": lambda: word(1) + word(2) + word(3), "dashes": lambda: "-".join(map(word, range(3 + i % 9))), "word": lambda: word(1),
        "camel": lambda: word(1) + word(2).title() + word(3).title() + word(4).title(), "key_name": lambda: KEY_NAMES[i % len(KEY_NAMES)], "stand_in": lambda: STAND_IN_TEXTS[i % len(STAND_IN_TEXTS)],
    }
    return makers[kind]()


def template_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """(before, candidate, after, label): half secrets and half others, over all templates in turn; a bounded table as one literal."""
    rows = []
    for i in range(n):
        own = SECRETS if i % 2 == 0 else OTHERS
        before, kind, after = own[i // 2 % len(own)]
        rows.append({"before": ("", "text before. ", "set\n", "| ")[i // 7 % 4] + before, "candidate": _made(kind, i), "after": after + " more", "label": float(i % 2 == 0)})
    shape = "array<struct<before:string,candidate:string,after:string,label:double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), shape)))


def _assembled(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    flat = rows.select("*", features(lexicon).alias("_f")).select("*", *[F.col(f"_f.{c}").alias(f"_f_{c}") for c in COLUMNS])
    return VectorAssembler(inputCols=[f"_f_{c}" for c in COLUMNS], outputCol="_features").transform(flat)


def train(labelled: DataFrame, lexicon: Lexicon, seed: int = 17) -> Scanner:
    """A forest fitted on (candidate, before, after, label 0.0 or 1.0); fits on a bounded table of findings, runs jobs."""
    forest = RandomForestClassifier(labelCol="label", featuresCol="_features", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    # Materialised first: the expressions that make findings and those of the features are too large as one.
    return Scanner(forest.fit(_assembled(checkpoint(labelled), lexicon)), lexicon)


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, place, candidate, probability, is_secret) of every candidate of every row.

    Null, empty and plain texts give no rows; repeated rows give theirs again; other columns are left aside; no rows give no rows.
    """
    scored = scanner.forest.transform(_assembled(candidates(docs, id_col, text_col), scanner.lexicon))
    chance = vector_to_array("_probability")[1]
    return scored.select(id_col, F.col("place").cast("long").alias("place"), "candidate", F.round(chance, 9).alias("probability"), (chance >= threshold).alias("is_secret"))
