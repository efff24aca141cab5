"""Secret scans with multipart credential linking, in DataFrame expressions only.

Strong parts are reported wherever they are: `assign` (a password, secret, token or API key that is set to 8 or more
characters), `access` (an access key id) and `hex` (32 or more hexadecimal digits). Weak parts are reported only if
complementary parts lie within `SCOPE` code points (start to start) in the same text:

    login     a user, login, client id or account that is set: with a secret (assign, hex or key) in scope
    key       a bare 40-character key: with an identifier (access or login) in scope
    endpoint  a URL or a host with a port: with both an identifier and a secret in scope

Matches and what lies between them give the positions, by a running sum over a text's matches, so texts are only scanned,
never split by character. A link joins a weak part to a part that complements it: an equal-join on the text and a bucket
of SCOPE code points (each weak part looks into its own bucket and the two beside it), with the interval as the rest of
the condition. A part has as many partners as parts fit into its scope, so links grow with the parts, not with their
square, and a long text's parts are spread over its buckets. Only texts with a match leave the scan, as numbers.

Cases: a null text is empty; repeated rows and ids are scanned one by one; a text without parts has zero counts, an
empty `spans` and the digest of the empty string; parts that start together are listed as above; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.llm import common

NAME, SQL = "op4_linked_secrets", None

SCOPE = 200

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
LOGIN = r"""(?<![A-Za-z0-9_])(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
KEY = "(?<![A-Za-z0-9+/_.=-])(?![0-9a-f]{40})[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.=-])"
ENDPOINT = r"""[a-z][a-z0-9+]{1,9}://[^\s"'<>]{4,}|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+[a-z]{2,}:[0-9]{2,5}(?![0-9])"""

LEAST_VALUE = 8

KINDS = ("assign", "access", "hex", "login", "key", "endpoint")
STRONG, WEAK = KINDS[:3], KINDS[3:]
#: What complements a weak part.
IDENTIFIERS, SECRETS = ("access", "login"), ("assign", "hex", "key")
PARTNERS = {"login": SECRETS, "key": IDENTIFIERS, "endpoint": IDENTIFIERS + SECRETS}


def is_(col: Column, kinds: tuple[str, ...]) -> Column:
    return col.isin([KINDS.index(k) for k in kinds])


def matches(text: Column, pattern: str, maybe: Column, group: int | None = None) -> Column:
    """The matches of a pattern as structs of code points: before (since the last match), size, and value (of the group). Texts for
    which `maybe` is false have none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("before"), found.alias("match"), value.alias("value")), lambda x: x["match"].isNotNull())
    sizes = F.transform(zipped, lambda x: F.struct(F.length(x["before"]).alias("before"), F.length(x["match"]).alias("size"), F.length(x["value"]).alias("value")))
    return F.when(maybe, sizes).otherwise(F.array().cast("array<struct<before:int,size:int,value:int>>"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid (a number of the row), doc_id, and for each of KINDS an array of its matches."""
    text = F.col("text")
    rows = common.documents(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    has = lambda *words: F.expr(" OR ".join(f"contains(low, '{w}')" for w in words))
    rows = rows.withColumn("low", F.lower("text"))
    rows = rows.select(
        "rid",
        "doc_id",
        "text",
        matches(text, ASSIGN, has("password", "passwd", "secret", "token", "apikey", "api_key"), 2).alias("assign"),
        matches(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        matches(text, HEX, text.rlike(HEX)).alias("hex"),
        has("user", "login", "client", "account").alias("named"),
    )
    rows = rows.withColumn("login", matches(text, LOGIN, F.col("named")))
    someone = (F.size("access") + F.size("login")) > 0
    rows = rows.withColumn("key", matches(text, KEY, someone & text.rlike(KEY)))
    both = someone & ((F.size("assign") + F.size("hex") + F.size("key")) > 0)
    return rows.withColumn("endpoint", matches(text, ENDPOINT, both & F.contains(text, F.lit(":")))).select("rid", "doc_id", *KINDS)


def parts(found: DataFrame) -> DataFrame:
    """rid, start, ord (the place in KINDS), end of every part."""
    numbered = lambda k, o: F.transform(k, lambda x, i: F.struct(F.lit(o).alias("ord"), i.alias("i"), x["before"].alias("before"), x["size"].alias("size"), x["value"].alias("value")))
    every = F.concat(*(numbered(k, o) for o, k in enumerate(KINDS)))
    rows = found.where(" OR ".join(f"size({k}) > 0" for k in KINDS)).select("rid", F.explode(every).alias("p")).select("rid", "p.*")
    upto = F.sum(F.col("before") + F.col("size")).over(Window.partitionBy("rid", "ord").orderBy("i")).cast("int")
    rows = rows.withColumn("end", upto).withColumn("start", upto - F.col("size"))
    return rows.where(~is_(F.col("ord"), ("assign",)) | (F.col("value") >= LEAST_VALUE)).select("rid", "start", "ord", "end")


def links(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rid, weak and partner (structs of start, ord, end): every weak part with every part in scope that complements it."""
    part = F.struct("start", "ord", "end")
    bucket = F.floor(F.col("start") / scope)
    weak = rows.where(is_(F.col("ord"), WEAK)).select("rid", part.alias("weak"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    partner = rows.where(is_(F.col("ord"), IDENTIFIERS + SECRETS)).select(F.col("rid").alias("r"), part.alias("partner"), bucket.alias("b"))
    complement = F.lit(False)
    for kind, kinds in PARTNERS.items():
        complement = complement | is_(F.col("weak.ord"), (kind,)) & is_(F.col("partner.ord"), kinds)
    near = F.abs(F.col("weak.start") - F.col("partner.start")) <= scope
    return weak.join(partner, (F.col("rid") == F.col("r")) & (F.col("bucket") == F.col("b")) & near & complement).select("rid", "weak", "partner")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, spans (array of start, ord, end, in order: strong parts, and weak ones with their complement in scope), links (array of
    weak and partner) of every row."""
    found = common.written(scanned(docs, id_col, text_col))
    rows = common.written(parts(found))
    pairs = common.written(links(rows, scope))
    has = lambda kinds: F.max(is_(F.col("partner.ord"), kinds))
    shown = pairs.groupBy("rid", "weak").agg(has(IDENTIFIERS).alias("someone"), has(SECRETS).alias("secret"), F.sort_array(F.collect_list("partner")).alias("partners"))
    shown = shown.where(~is_(F.col("weak.ord"), ("endpoint",)) | F.col("someone") & F.col("secret"))
    strong = rows.where(is_(F.col("ord"), STRONG)).select("rid", F.struct("start", "ord", "end").alias("span"), F.lit(None).cast("array<struct<start:int,ord:int,end:int>>").alias("partners"))
    spans = strong.unionByName(shown.select("rid", F.col("weak").alias("span"), "partners")).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("span", "partners"))).alias("all"))
    joined = found.select("rid", "doc_id").join(spans, "rid", "left")
    own = F.coalesce(F.transform("all", lambda x: x["span"]), F.array().cast("array<struct<start:int,ord:int,end:int>>"))
    of = F.coalesce(F.flatten(F.transform(F.filter("all", lambda x: x["partners"].isNotNull()), lambda x: F.transform(x["partners"], lambda p: F.struct(x["span"].alias("weak"), p.alias("partner"))))), F.array().cast("array<struct<weak:struct<start:int,ord:int,end:int>,partner:struct<start:int,ord:int,end:int>>>"))
    return joined.select("doc_id", own.alias("spans"), of.alias("links"))


def listed(spans_: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["ord"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = listed(F.filter("spans", lambda s: s["ord"] <= KINDS.index("hex")))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("links").cast("long").alias("n_links"))
