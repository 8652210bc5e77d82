"""Labelled findings for the secret scanner's forest: forms of tokens that are public knowledge, in the places where they stand.

A form is a label (1: a secret), the text before the token, the token, the text after it, and a path. Fields in angle
brackets are filled anew in each row, always the same way: <hex:40> 40 hexadecimal digits, <alnum:20-40> 20 to 40 letters and digits, <b64:..>, <url:..>
base64 in its two alphabets, <up:..> upper-case letters and digits, <low:..> lower-case ones, <dig:..> digits, <let:..> random small letters,
<word> and <Word> a word. ``findings`` fills them with Spark's own functions; a table of one's own with the same columns can
take its place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Words of running text, names and slugs.
WORDS = (
    "harbour lantern meadow copper window silver orchard river garden marble winter thunder candle forest island bottle kitchen shadow ribbon velvet"
    " anchor basket butter castle desert engine falcon ginger hammer jungle kettle ladder mirror needle ocean pepper quartz rocket saddle timber umbrella"
    " valley walnut yellow zebra bridge cheese dragon eagle feather glacier honey insect jacket ketchup lemon mountain nation orange planet rabbit season"
).split()

FORMS = (
    # Secrets, named as such.
    (1, 'api_key = "', "<alnum:24-40>", '"\n', "src/app/settings.py"),
    (1, "API_KEY=", "<alnum:32>", "\n", "deploy/.env"),
    (1, "<word> token: ", "<hex:40>", "\n", "notes/setup.md"),
    (1, 'token = "', "<hex:40>", '" and', ""),
    (1, 'the <word> has token = "', "<hex:32>", '" in', ""),
    (1, "export AUTH_TOKEN='", "<hex:64>", "'\n", "bin/run.sh"),
    (1, '"client_secret": "', "<url:28-44>", '",\n', "conf/oauth.json"),
    (1, "aws_secret_access_key = ", "<b64:40>", "\n", "home/.aws/credentials"),
    (1, 'secretKey: "', "<b64:43>=", '",\n', "lib/sign.js"),
    (1, "Authorization: Bearer ", "<url:40-64>", "\n", "logs/request.txt"),
    (1, "private_token=", "<alnum:20>", "&page=", "docs/<word>.txt"),
    (1, 'encryption_key: "', "<hex:64>", '"\n', "conf/<word>.yml"),
    (1, "signing secret is ", "<hex:32>", ", keep it", ""),
    # Secrets with a prefix of their kind, named or alone.
    (1, "<word> <word> ", "ghp_<alnum:36>", " <word>", ""),
    (1, "git clone https://", "ghp_<alnum:36>", "@example.org/x", "bin/<word>.sh"),
    (1, "<word>: ", "github_pat_<alnum:22>_<alnum:59>", "\n", ""),
    (1, "use ", "glpat-<url:20>", " for <word>", ""),
    (1, "key ", "AKIA<up:16>", " of <word>", "src/<word>.tf"),
    (1, "<word> <word> ", "ASIA<up:16>", ".", ""),
    (1, "stripe.api_key = '", "sk_live_<alnum:24>", "'\n", "src/pay.rb"),
    (1, "<word> ", "rk_live_<alnum:24>", " <word>", ""),
    (1, "slack: ", "xoxb-<dig:12>-<dig:12>-<alnum:24>", "\n", "src/bot.py"),
    (1, "<word> ", "xoxp-<dig:11>-<dig:11>-<dig:12>-<hex:32>", " <word>", ""),
    (1, "<word>(", "AIza<url:35>", ")", "web/map.js"),
    (1, "<word> ", "npm_<alnum:36>", "\n", "home/.npmrc"),
    (1, "password = ", "pypi-AgEIcHlwaS5vcmc<url:70>", "\n", "home/.pypirc"),
    (1, "<word> ", "sk-<alnum:48>", " <word>", ""),
    (1, "hook ", "whsec_<alnum:32>", ",", "src/<word>.go"),
    (1, "mail key SG.", "<url:22>.<url:43>", "\n", "src/mail.py"),
    (1, "<word> ", "hf_<alnum:34>", " <word>", ""),
    (1, "<word> ", "dop_v1_<hex:64>", " <word>", ""),
    (1, "cookie: session=", "eyJhbGciOiJIUzI1NiJ9.eyJ<url:40-80>.<url:43>", ";", "logs/<word>.log"),
    (1, "<word> ", "eyJhbGciOiJSUzI1NiIsInR5cCI6IkpXVCJ9.eyJ<url:60-80>.<url:64>", " <word>", ""),
    # Key blocks and credentials in addresses.
    (1, "-----BEGIN RSA PRIVATE KEY-----\n", "MIIE<b64:60>\n<b64:64>\n<b64:64>=\n", "-----END RSA PRIVATE KEY-----", "home/id_rsa"),
    (1, "-----BEGIN PRIVATE KEY-----\n", "MIIEv<b64:59>\n<b64:64>\n<b64:20>==\n", "-----END PRIVATE KEY-----", ""),
    (1, "-----BEGIN OPENSSH PRIVATE KEY-----\n", "b3BlbnNzaC1rZXk<b64:55>\n<b64:70>\n", "-----END OPENSSH PRIVATE KEY-----", ""),
    (1, "postgres://<word>:", "<alnum:12-20>", "@db.<word>.org:5432/", "conf/db.yml"),
    (1, "amqp://<word>:", "<word><dig:3>!", "@<word>.org/", ""),
    (1, "mysql://root:", "<alnum:8>#<alnum:4>", "@10.0.0.7/<word>", "src/<word>.php"),
    # Passwords.
    (1, 'password = "', "<word><dig:2>!", '"\n', "src/<word>.py"),
    (1, "password: '", "<Word>#<dig:4>", "'\n", "conf/<word>.yml"),
    (1, 'passwd="', "<let:3>@<alnum:8>$", '"', "bin/<word>.sh"),
    (1, "DB_PASSWORD=", "<alnum:14>", "\n", "deploy/.env"),
    (1, "secret: ", "<word><word><word><word>", "\n", "conf/<word>.yml"),
    (1, "the password is: ", "<Word><dig:4>?", "\n", ""),
    (1, 'pwd: "', "<Word>-<Word>-<dig:2>", '"', "notes/<word>.txt"),
    # Hashes, checksums and ids.
    (0, "commit ", "<hex:40>", "\nAuthor: <word>", "log.txt"),
    (0, "<word> <word> ", "<hex:40>", " <word>", ""),
    (0, "sha ", "<hex:40>", "\n", ""),
    (0, "index ", "<hex:32>", " 100644", "<word>.diff"),
    (0, "md5sum: ", "<hex:32>", "  <word>.tar", "SUMS"),
    (0, "sha256:", "<hex:64>", "\n", "image.lock"),
    (0, "digest = ", "<hex:64>", "\n", "<word>.lock"),
    (0, 'integrity="sha384-', "<b64:64>", '" cross', "web/<word>.html"),
    (0, '"integrity": "sha512-', "<b64:80>==", '",', "package-lock.json"),
    (0, "ETag: W/", "<hex:32>", "\n", "logs/<word>.log"),
    (0, "request id ", "<hex:8>-<hex:4>-4<hex:3>-a<hex:3>-<hex:12>", " <word>", ""),
    (0, "<word> ", "<hex:8>-<hex:4>-4<hex:3>-b<hex:3>-<hex:12>", ", <word>", ""),
    (0, 'uuid: "', "<hex:8>-<hex:4>-4<hex:3>-9<hex:3>-<hex:12>", '"', "data/<word>.json"),
    (0, "etag: ", "<hex:32>-<dig:2>", "\n", ""),
    (0, 'content-hash = "', "<hex:40>", '"', "<word>.lock"),
    (0, "cache key: ", "<word>-<word>-<hex:16>", "\n", ".ci/<word>.yml"),
    # Numbers.
    (0, "<word> <word> ", "<dig:16>", " <word>", ""),
    (0, "call ", "<dig:12>", " now", ""),
    (0, "order ", "<dig:14>", " of <word>", ""),
    (0, "ISBN ", "978<dig:10>", ", <word>", ""),
    (0, "card ", "<dig:4>-<dig:4>-<dig:4>-<dig:4>", "\n", ""),
    (0, "<word> on ", "2021-0<dig:1>-1<dig:1>T12", ":00", "logs/<word>.log"),
    (0, "token count: ", "<dig:12>", "\n", "logs/<word>.log"),
    # Names, paths, slugs and versions.
    (0, "see ", "<word>/<word>/<word>-<dig:2>", "/<word>", "docs/<word>.md"),
    (0, "https://<word>.org/", "<word>-<word>-<word>-<dig:5>", ".html", ""),
    (0, "import ", "<word>_<word>_v<dig:1>", "\n", "src/<word>.py"),
    (0, "<word>(", "get<Word><Word>By<Word>2", ")", "src/<word>.java"),
    (0, "class=\"", "<word>-<word>__<word>--<dig:2>", '"', "web/<word>.html"),
    (0, "img src=data:image/png;base64,", "iVBORw0KGgo<b64:70>", "\n", "web/<word>.html"),
    (0, "url(data:font/woff2;base64,", "d09GMgABAAAA<b64:70>", ")", "web/<word>.css"),
    (0, "ssh-rsa ", "AAAAB3NzaC1yc2E<b64:70>", " <word>@<word>", "home/id_rsa.pub"),
    (0, "-----BEGIN CERTIFICATE-----\n", "MIID<b64:60>", "\n", "<word>.pem"),
    (0, "version ", "<word>-<dig:1>.<dig:2>.<dig:1>-linux-x86_64", "\n", ""),
    (0, "<word> <word>, ", "<word>-<word>-<word>2", " and", ""),
    (0, "password field: ", "<word>_<word>_<word>", "\n", "src/<word>.html"),
    (0, "the key: ", "<word>", " and <word>", ""),
    (0, "a secret: ", "<word>ing", " by the <word>", ""),
    # Placeholders and samples.
    (0, 'api_key = "', "your_api_key_here", '"\n', "README.md"),
    (0, 'password = "', "your_password_<dig:3>", '"', "docs/example"),
    (0, "token: ", "<word>_TOKEN_HERE_123", "\n", "docs/<word>.md"),
    (0, 'secret = "', "xxxxxxxxxxxxxxxx<dig:2>", '"', "README.md"),
    (0, "API_KEY=", "EXAMPLE_KEY_<dig:4>", "\n", "example.env"),
    (0, 'password: "', "changeme<dig:3>", '"', "conf/sample.yml"),
    (0, 'password = "', "password<dig:1>", '"', "tests/test_login.py"),
    (0, "password = ", "os.environ['<word>']", "\n", "src/<word>.py"),
    (0, "token: ", "${<word>_TOKEN}", "\n", "deploy/<word>.yml"),
    (0, 'secret = "', "<alnum:20-30>", '"', "tests/fixtures/<word>.json"),
    (0, "token = '", "<hex:32>", "'", "spec/mocks/<word>.rb"),
    (0, "secret_key = ", "config.get_secret_key()", "\n", "src/<word>.py"),
    (0, 'key: "', "<word>.<word>.title", '"', "i18n/<word>.json"),
    (0, 'primary key "', "<word>_<word>_id", '"', "db/<word>.sql"),
)

_FIELD = re.compile(r"<(\w+)(?::(\d+)(?:-(\d+))?)?>")


#: Sets of random strings that a row's fields are taken from.
POOLS = 6


def _pools(rows: DataFrame) -> DataFrame:
    """Adds POOLS sets of a number and random strings (n0, hex0, b640 ...) and the words to rows of i."""
    out = {"words": F.array(*(F.lit(w) for w in WORDS))}
    for k in range(POOLS):
        seed = F.concat_ws("|", F.lit(k), F.col("i").cast("string"))
        out |= {f"n{k}": F.pmod(F.xxhash64(seed), F.lit(1 << 31)), f"hex{k}": F.sha2(seed, 512)}
    rows = rows.withColumns(out)
    rows = rows.withColumns({f"b64{k}": F.regexp_replace(F.base64(F.unhex(F.concat(f"hex{k}", F.sha2(f"hex{k}", 256)))), "[=\\s]", "") for k in range(POOLS)})
    return rows.withColumns({f"alnum{k}": F.regexp_replace(f"b64{k}", "[+/]", "") for k in range(POOLS)})


def _filled(template: str, first: int) -> Column:
    """A template with its fields filled from the pools, from the one numbered `first` on."""
    parts, at = [], 0
    for k, m in enumerate(_FIELD.finditer(template)):
        parts.append(F.lit(template[at : m.start()]))
        at, pool = m.end(), (first + k) % POOLS
        n, kind, least, most = F.col(f"n{pool}"), m[1], int(m[2] or 0), int(m[3] or m[2] or 0)
        if kind in ("word", "Word"):
            word = F.element_at("words", (n % len(WORDS) + 1).cast("int"))
            parts.append(F.initcap(word) if kind == "Word" else word)
            continue
        plain = F.col(f"alnum{pool}")
        text = {
            "hex": F.col(f"hex{pool}"), "b64": F.col(f"b64{pool}"), "url": F.translate(f"b64{pool}", "+/", "-_"), "alnum": plain, "up": F.upper(plain), "low": F.lower(plain),
            "dig": F.translate(f"hex{pool}", "abcdef", "270461"), "let": F.translate(F.lower(plain), "0123456789", "qwzxvbnmkj"),
        }[kind]
        parts.append(F.left(text, (F.lit(least) + n % (most - least + 1)).cast("int")))
    return F.concat(*parts, F.lit(template[at:]))


#: Forms that one plan fills: generated code for many more would be too long to be compiled.
FORMS_AT_ONCE = 8


def findings(spark: SparkSession, rows: int, forms=FORMS) -> DataFrame:
    """token, left, right, path and label of `rows` findings, dealt evenly over the forms; the same in any run, and made once: a written table in four parts."""
    pools, table = _pools(spark.range(0, rows, 1, 4).toDF("i")), None
    for first in range(0, len(forms), FORMS_AT_ONCE):
        own = forms[first : first + FORMS_AT_ONCE]
        kind = F.col("i") % len(forms) - first

        def column(place: int, own=own, kind=kind) -> Column:
            out = None
            for k, form in enumerate(own):
                value = _filled(form[place], 2 * place)
                out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
            return out

        labels = F.element_at(F.array(*(F.lit(float(f[0])) for f in own)), (kind + 1).cast("int"))
        part = pools.where(kind.between(0, len(own) - 1)).select("i", column(2).alias("token"), column(1).alias("left"), column(3).alias("right"), column(4).alias("path"), labels.alias("label"))
        table = part if table is None else table.union(part)
    table = c.written(table, "findings")
    return table.repartitionById(4, F.floor(F.col("i") * 4 / max(rows, 1)).cast("int")).sortWithinPartitions("i").drop("i")
