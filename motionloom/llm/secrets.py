"""Secret scans: candidate tokens judged by a random forest, in DataFrame operations only.

Candidates are, where they don't overlap an earlier one: bodies of private key blocks; passwords in addresses (``://name:...@``); whole quoted
values of QUOTED characters or more, whatever they hold, after a name for secrets and an assignment; unquoted ones of UNQUOTED or more; and runs
of token characters, at least MIN_LENGTH long and joined by dots if each is, that hold a digit (the first of them) or stand
in quotes after an assignment. A random forest (trained with Spark's own, on labelled
findings) removes false positives by: length; character transitions (between digits, lower and upper case,
vowels and consonants, distinct characters); dictionary coverage (share of the token that common words and
placeholders make up); path (test, sample and document places, slashes and dots around the token); and
neighbouring words (those that name secrets, or hashes, ids and numbers, on the left; an assignment, quotes, a key block, an address).

Labelled findings: ``findings`` has forms of tokens that are public knowledge (see there), from which a bounded set is
made. Secrets of fewer characters than the limits above aren't found, nor are passwords that neither a name nor an address points at.

Positions are code points from 0. Defined cases. Null and empty texts have no candidates. A text's own
control characters x01 and x02 are read as blanks. A candidate has any length. A repeated token is a finding each time; rows that repeat a doc_id are
scanned one by one.
An empty table gives no rows. Other columns are not used.

Scale. One scan of the text without shuffle; findings are exploded with 64 characters around them. The forest is
trained on a fixed number of rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import findings

MIN_LENGTH, QUOTED, UNQUOTED, AROUND = 12, 6, 8, 64
#: Token characters: a digit somewhere, or quotes after = or :.
TOKEN = r"[A-Za-z0-9+/_\-]"
_RUN = rf"{TOKEN}{{{MIN_LENGTH},}}+"
#: Names for secrets before an assignment, as far as a look-behind reaches.
_NAMED = r"(?i:passwords?|passwd|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth)[A-Za-z0-9_]{0,16}[\"']? {0,3}[=:]{1,2}>? {0,3}"
#: No candidate begins inside a word; what that leaves is tried rule by rule, cheap conditions first.
CANDIDATE = r"(?<![A-Za-z0-9])(?:" + "|".join((
    r"(?<=-)(?<=-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)[A-Za-z0-9+/=\s]{40,}+(?=-----END)",
    r"(?<=:)(?<=://[^\s:/@\"']{1,64}:)[^\s:/@\"']{4,}+(?=@)",
    rf"(?<=[\"'`])(?<={_NAMED}[\"'`])[^\"'`\n\x01\x02]{{{QUOTED},}}+(?=[\"'`])",
    rf"(?<=[=:>]|[=:>] |[=:>]  |[=:>]   )(?![\s\"'`=:>])(?<={_NAMED})[^\s\"'`,;\x01\x02]{{{UNQUOTED},}}+",
    rf"(?=[A-Za-z+/_\-]*+[0-9])(?<!{TOKEN}){_RUN}(?:\.{_RUN})*+={{0,2}}",
    rf"(?<=[\"'])(?<=[=:] ?[\"']){_RUN}={{0,2}}(?=[\"'])",
)) + ")"
#: Fixed value: characters that are counted apart.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Running sums are made in blocks of this many parts, since each of their steps copies the sums so far.
STEP = 256

# Words that tell findings apart.
SECRET_WORDS = "access auth authorization bearer credential credentials key passwd password private pwd secret signature token".split()
PLAIN_WORDS = "build card checksum commit digest etag hash id integrity invoice isbn md5 order phone ref revision sha sha1 sha256 tracking uuid version".split()
DICTIONARY = (
    "abc account admin alpha api app apple base beta blue book change changeme class client cloud code common config data date default demo dev"
    " dummy example fake file first foo bar baz from green hello home house image index insert internal key last line link list local main master member message"
    " mock name network new null number open order page pass password path placeholder platform prod public query random record replace report request"
    " response road root sample secret section server service session shop size some staging state string style sun system table test text that this time"
    " title token tree type update user value version view water window with word work world xxxx year your"
).split()
PLACES = r"(^|[/_.\-])(test|tests|testing|example|examples|sample|samples|mock|mocks|fixture|fixtures|doc|docs|spec)([/_.\-]|$)"

FEATURES = (
    "length", "digit_letter", "letter_digit", "upper_lower", "lower_upper", "vowel_consonant", "distinct", "digits", "hex", "covered",
    "in_path", "path_around", "test_path", "secret_word", "plain_word", "assigned", "quoted", "padded", "upper", "marks", "prefix", "key_block", "address",
)
TREES, DEPTH, SEED, ROWS = 40, 12, 42, 9600


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, start, token, left and right (AROUND characters) of each candidate."""
    text = F.translate(F.coalesce("text", F.lit("")), "\x01\x02", "  ")
    pieces = F.split(F.regexp_replace(text, f"({CANDIDATE})", "\x01$1\x02"), "\x01")
    x = docs.select(F.col("doc_id"), F.coalesce("source", F.lit("")).alias("path"), pieces.alias("pieces")).where(F.size("pieces") > 1)
    token = lambda p: F.substring_index(p, "\x02", 1)
    rest = lambda p: F.substring_index(p, "\x02", -1)
    # Each piece but the first: its token, what follows it up to the next, and how far it reaches.
    parts = F.transform("pieces", lambda p, i: F.struct(F.when(i > 0, token(p)).alias("token"), F.left(rest(p), F.lit(AROUND)).alias("head"), F.right(rest(p), F.lit(AROUND)).alias("tail"), (F.length(p) - F.when(i > 0, 1).otherwise(0)).cast("long").alias("size")))
    x = x.select("doc_id", "path", parts.alias("parts"))
    block = lambda b: F.slice("parts", b * STEP + 1, F.lit(STEP))
    blocks = F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / STEP).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0).cast("long"), lambda s, p: s + p["size"]))
    x = x.select("doc_id", "path", "parts", _before(sums, lambda s: s, F.lit(0).cast("long")).alias("base"))
    places = F.flatten(F.transform(blocks, lambda b: _before(block(b), lambda p: p["size"], F.get("base", b))))
    x = x.select("doc_id", "path", "parts", places.alias("places"))
    # Whole findings before they are exploded, so that no row carries its document's arrays.
    at = F.sequence(F.lit(1), F.size("parts") - 1)
    found = F.transform(at, lambda i: F.struct(F.get("places", i).alias("start"), F.get("parts", i)["token"].alias("token"), F.get("parts", i - 1)["tail"].alias("left"), F.get("parts", i)["head"].alias("right")))
    return x.select("doc_id", "path", F.explode(found).alias("x")).select("doc_id", "path", "x.*")


def _before(items: Column, size, start: Column) -> Column:
    """The sum of the sizes before each item, from start."""
    sums = F.aggregate(items, F.array(start), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + size(x))))
    return F.slice(sums, F.lit(1), F.size(items))


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def described(found: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of token, left, right and path."""
    token, left, right = F.col("token"), F.lower("left"), F.col("right")
    size = F.length(token)
    share = lambda n: n / size
    count = lambda pattern, text=token: F.regexp_count(text, F.lit(pattern)).cast("double")
    near = F.right(left, F.lit(32))
    values: dict[str, Column] = {
        "length": size.cast("double"),
        "digit_letter": share(count(r"[0-9](?=[A-Za-z])")),
        "letter_digit": share(count(r"[A-Za-z](?=[0-9])")),
        "upper_lower": share(count(r"[A-Z](?=[a-z])")),
        "lower_upper": share(count(r"[a-z](?=[A-Z])")),
        "vowel_consonant": share(count(r"[aeiouy](?=[bcdfghjklmnpqrstvwxz])|[bcdfghjklmnpqrstvwxz](?=[aeiouy])", F.lower(token))),
        "distinct": (len(ALPHABET) - F.length(F.call_function("translate", F.lit(ALPHABET), token, F.lit("")))) / F.sqrt(size),
        "digits": share(count("[0-9]")),
        "hex": token.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(token), _any(DICTIONARY), "")) / size,
        "in_path": share(count("[/._]")),
        "path_around": (F.right(left, F.lit(1)).isin("/", ".", "@", "#") | F.left(right, F.lit(1)).isin("/", ".", "@")).cast("double"),
        "test_path": F.lower("path").rlike(PLACES).cast("double"),
        "secret_word": near.rlike(rf"(?<![a-z])({_any(SECRET_WORDS)})s?(?![a-z])").cast("double"),
        "plain_word": near.rlike(rf"(?<![a-z])({_any(PLAIN_WORDS)})(?![a-z])").cast("double"),
        "assigned": left.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (left.rlike(r"[\"'`]$") & right.rlike(r"^[\"'`]")).cast("double"),
        "padded": token.endswith("=").cast("double"),
        "upper": share(count("[A-Z]")),
        "marks": share(count(r"[^A-Za-z0-9+/_\-=.\s]")),
        "prefix": token.rlike(r"^[A-Za-z]{2,6}[_\-][A-Za-z0-9]").cast("double"),
        "key_block": left.rlike(r"private key-----\s*$").cast("double"),
        "address": (left.rlike(r"://[^\s:/@]*:$") & right.startswith("@")).cast("double"),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in values.items()})


def train(labelled: DataFrame) -> PipelineModel:
    """The forest: an assembler and a random forest, both Spark's own."""
    table = described(labelled).select(*FEATURES, "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return PipelineModel([vectors, forest.fit(vectors.transform(table))])


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, token, redacted, probability and is_secret of each candidate."""
    model = train(findings(docs.sparkSession, ROWS) if labelled is None else labelled)
    judged = model.transform(described(candidates(docs))).withColumn("probability", vector_to_array("probability")[1])
    hidden = F.concat(F.left("token", F.lit(4)), F.lit("…"), F.right("token", F.lit(2)))
    return judged.select("doc_id", "start", F.length("token").cast("long").alias("length"), "token", hidden.alias("redacted"), "probability", (F.col("probability") >= threshold).alias("is_secret"))
