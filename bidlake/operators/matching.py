"""Entity matching: staged cascades of equi joins and blocked similarity joins."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from bidlake.functions.text import GENERIC_DOMAINS, email_domain, norm_email, norm_key, norm_supplier, rfq_token
from bidlake.operators.changes import written

ORG = "organization_id"


@dataclass
class Stage:
    """Candidates ``(organization_id, left_id, right_id)`` of one rule. An ambiguous stage that ``stops`` ends the cascade. With ``members(organization_id,
    k, right_id)`` a candidate row stands for all ``n`` of them that have its key ``k``, and its right_id is the least."""

    method: str
    candidates: DataFrame
    score: float = 1.0
    stops: bool = True
    members: DataFrame | None = None

    def keyed(self) -> tuple[DataFrame, DataFrame]:
        """Candidates ``(organization_id, left_id, k, n, right_id)`` and members; pairs are keys of one member each."""
        if self.members is not None:
            return self.candidates, self.members
        pairs = self.candidates.withColumn("k", F.col("right_id").cast("string")).withColumn("n", F.lit(1).cast("long"))
        return pairs.select(ORG, "left_id", "k", "n", "right_id"), pairs.select(ORG, "k", "right_id").distinct()


def equal(method: str, left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, score: float = 1.0, stops: bool = True) -> Stage:
    """The stage of equal keys that are not empty; ``left(organization_id, left_id)``, ``right(organization_id, right_id)``. The right rows of a key are
    counted before the left ones meet them, so there is a row a left row, however many share its key."""
    a = left.select(ORG, "left_id", left_key.alias("k")).where("k <> ''")
    b = right.select(ORG, "right_id", right_key.alias("k")).where("k <> ''")
    counted = b.groupBy(ORG, "k").agg(F.count_distinct("right_id").alias("n"), F.min("right_id").alias("right_id"))
    return Stage(method, a.join(counted, [ORG, "k"]).select(ORG, "left_id", "k", "n", "right_id"), score, stops, b)


def cascade(left: DataFrame, stages: list[Stage]) -> DataFrame:
    """``organization_id, left_id, right_id, method, score, candidates`` for every row of ``left``: the first stage with exactly one
    candidate, unless an ambiguous stage that stops comes before it. One aggregation over all stages' keys; only where rows of one
    left id have several keys are the candidates themselves counted."""
    at = [ORG, "left_id", "stage", "stops"]
    staged = lambda df, i: df.withColumn("stage", F.lit(i))
    found = reduce(DataFrame.unionByName, (staged(s.keyed()[0], i).withColumn("stops", F.lit(s.stops)) for i, s in enumerate(stages)))
    keys = found.groupBy(*at).agg(F.collect_set(F.struct("k", "n", "right_id")).alias("keys"))
    one_key = keys.where(F.size("keys") == 1).select(*at, F.col("keys")[0]["n"].alias("n"), F.col("keys")[0]["right_id"].alias("right_id"))
    members = reduce(DataFrame.unionByName, (staged(s.keyed()[1], i) for i, s in enumerate(stages)))
    several = keys.where(F.size("keys") > 1).select(*at, F.explode("keys.k").alias("k")).join(members, [ORG, "stage", "k"])
    per = one_key.unionByName(several.groupBy(*at).agg(F.count_distinct("right_id").alias("n"), F.min("right_id").alias("right_id")))
    first = per.where("n = 1 OR stops").groupBy(ORG, "left_id").agg(F.min(F.struct("stage", "n", "right_id")).alias("m"))
    names, scores = F.array(*(F.lit(s.method) for s in stages)), F.array(*(F.lit(s.score) for s in stages))
    one = F.col("m.n") == 1
    return left.select(ORG, "left_id").join(first, [ORG, "left_id"], "left").select(
        ORG,
        "left_id",
        F.when(one, F.col("m.right_id")).alias("right_id"),
        F.when(F.col("m").isNull(), "NO_MATCH").when(one, names[F.col("m.stage")]).otherwise(F.concat(F.lit("AMBIGUOUS_"), names[F.col("m.stage")])).alias("method"),
        F.when(one, scores[F.col("m.stage")]).otherwise(0.0).alias("score"),
        F.coalesce("m.n", F.lit(0)).alias("candidates"),
    )


def _sides(left: DataFrame, left_id: str, right: DataFrame, right_id: str) -> tuple[DataFrame, DataFrame]:
    return left.withColumnRenamed(left_id, "left_id"), right.withColumnRenamed(right_id, "right_id")


def match_suppliers(quoted: DataFrame, suppliers: DataFrame, left_id: str) -> DataFrame:
    """Of ``quoted(organization_id, <left_id>, name, email)`` the supplier by name, else alias, else mail domain; the first stage that
    finds any decides, and only if it finds one."""
    a, b = _sides(quoted, left_id, suppliers, "supplier_id")
    aliases = b.select(ORG, "right_id", F.explode("aliases").alias("alias"))
    return cascade(a, [
        equal("NAME", a, b, norm_key(F.col("name")), norm_key(F.col("name"))),
        equal("ALIAS", a, aliases, norm_key(F.col("name")), norm_key(F.col("alias"))),
        equal("DOMAIN", a, b, email_domain(F.col("email")), F.lower("email_domain")),
    ])


def match_senders(senders: DataFrame, suppliers: DataFrame, contacts: DataFrame, left_id: str) -> DataFrame:
    """Of ``senders(organization_id, <left_id>, email, name)`` the supplier by contact address (ambiguity stops), own domain (ambiguity
    stops), alias, then name."""
    a, b = _sides(senders, left_id, suppliers, "supplier_id")
    c = contacts.withColumnRenamed("supplier_id", "right_id").join(b.select(ORG, "right_id"), [ORG, "right_id"], "left_semi")
    domain = F.when(~email_domain(F.col("email")).isin(*GENERIC_DOMAINS), email_domain(F.col("email")))
    aliases = b.select(ORG, "right_id", F.explode("aliases").alias("alias"))
    return cascade(a, [
        equal("EXACT_CONTACT_EMAIL", a, c, norm_email(F.col("email")), norm_email(F.col("email")), 1.0),
        equal("EXACT_VERIFIED_DOMAIN", a, b, domain, F.lower("email_domain"), 0.99),
        equal("KNOWN_ALIAS", a, aliases, norm_supplier(F.col("name")), norm_supplier(F.col("alias")), 0.98, False),
        equal("NORMALIZED_NAME", a, b, norm_supplier(F.col("name")), norm_supplier(F.col("name")), 0.97, False),
    ])


def match_items(lines: DataFrame, items: DataFrame, aliases: DataFrame, mappings: DataFrame, left_id: str) -> DataFrame:
    """Of ``lines(organization_id, <left_id>, supplier_id, sku, mpn)`` the item by SKU, maker's number, the supplier's confirmed mapping, then
    alias; a stage counts only if it finds exactly one."""
    a, b = _sides(lines, left_id, items, "item_id")
    confirmed = mappings.withColumnRenamed("item_id", "right_id")
    own = lambda sku: F.when(F.col("supplier_id").isNotNull() & F.col(sku).isNotNull(), F.to_json(F.struct("supplier_id", F.col(sku).alias("sku"))))
    return cascade(a, [
        equal("SKU", a, b, norm_key(F.col("sku")), norm_key(F.col("sku")), stops=False),
        equal("MAKER", a, b, norm_key(F.col("mpn")), norm_key(F.col("manufacturer_part_number")), stops=False),
        equal("MAPPING", a, confirmed, own("sku"), own("supplier_sku"), stops=False),
        equal("KNOWN_ALIAS", a, aliases.withColumnRenamed("item_id", "right_id"), norm_key(F.col("sku")), norm_key(F.col("alias")), stops=False),
    ])


def match_rfqs(texts: DataFrame, rfqs: DataFrame, left_id: str, *sources: str, more: str | None = None) -> DataFrame:
    """Of ``texts(organization_id, <left_id>, rfq_id, <sources>)`` the request by an explicit id, else by the one distinct number that the
    sources name, if one request has it. ``more`` is an array of numbers that other texts name."""
    a, b = _sides(texts, left_id, rfqs, "request_id")
    others = F.coalesce(F.col(more), F.array().cast("array<string>")) if more else F.array().cast("array<string>")
    tokens = F.array_distinct(F.array_compact(F.concat(F.array(*(rfq_token(F.col(s)) for s in sources)), others)))
    a = a.withColumn("tokens", tokens)
    explicit = a.where("rfq_id is not null")
    named = a.where("rfq_id is null AND size(tokens) = 1")
    out = cascade(a, [
        equal("EXPLICIT", explicit, b, F.col("rfq_id").cast("string"), F.col("right_id").cast("string")),
        equal("NUMBER", named, b, F.get("tokens", F.lit(0)), F.col("number")),
    ])
    several = a.where("rfq_id is null AND size(tokens) > 1").select(ORG, "left_id", F.lit(True).alias("several"))
    out = out.join(several, [ORG, "left_id"], "left")
    return out.withColumn("method", F.when(F.col("several"), "AMBIGUOUS_NUMBER").otherwise(F.col("method"))).drop("several")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def _grams(df: DataFrame, n: int = 3) -> DataFrame:
    size = F.greatest(F.length("k") - (n - 1), F.lit(1))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("k", i, F.lit(n))))
    return df.select(ORG, "k", F.explode(grams).alias("g"))


def _split(texts: DataFrame) -> DataFrame:
    """Add a text's ``pairs`` of neighbouring characters and ``single`` ones, each sorted, as columns of their own: expressions would be computed anew
    for every element of the arrays that are made of them."""
    n = F.length("k")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring("k", i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    single = F.when(n > 0, F.split("k", "")).otherwise(F.array(F.lit("")))
    return texts.withColumns({"pairs": F.array_sort(pairs), "single": F.array_sort(single)})


def _numbered(sorted_: str) -> Column:
    """The elements of a sorted array with their number among equal ones."""
    return F.transform(sorted_, lambda x, i: F.concat(x, F.lit("#"), i + 2 - F.array_position(sorted_, x)))


def signatures(texts: DataFrame, order: DataFrame, least: float) -> DataFrame:
    """``organization_id, k, n, gram`` for distinct ``texts(organization_id, k)`` of length ``n``: the rarest pairs of characters of each text,
    as many as it takes that two texts of a ratio of ``least`` or more share one. ``order(gram, df)`` says how many texts have a pair.

    Texts of lengths a and b with that ratio share m >= least * (a + b) / 2 characters in order. Each other character breaks up to two
    of the pairs of its own text, and one of the other's, so at least 3m - a - b - 1 pairs are in both, repeats counted; and the other's
    length is within a * least / (2 - least) and its inverse. Of g pairs of which o are shared, any g - o + 1 hold a shared one, and both
    texts take their rarest. Where texts are so short that no pair need be shared, single characters are taken, of which m are."""
    n, low = F.length("k"), F.ceil(F.length("k") * least / (2 - least) - 1e-9)
    both = n + low
    shared = F.greatest(F.ceil((1.5 * least - 1) * both - 1 - 1e-9), F.lit(1))
    kinds = F.array(
        F.struct(_numbered("pairs").alias("grams"), (F.greatest(n - 1, F.lit(0)) - shared + 1).alias("take")),
        F.struct(_numbered("single").alias("grams"), F.when((1.5 * least - 1) * both - 1 < 1 + 1e-9, F.greatest(n - F.ceil(least * both / 2 - 1e-9) + 1, F.lit(1))).otherwise(0).alias("take")),
    )
    each = _split(texts).select(ORG, "k", n.alias("n"), F.posexplode(kinds).alias("kind", "own")).select(ORG, "k", "n", "kind", "own.take", F.explode("own.grams").alias("gram"))
    ranked = each.where("take > 0").join(F.broadcast(order), "gram", "left")
    place = F.row_number().over(Window.partitionBy(ORG, "k", "kind").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    return ranked.withColumn("place", place).where("place <= take").select(ORG, "k", "n", "gram")


def rarity(*texts: DataFrame) -> DataFrame:
    """``gram, df``: in how many ``texts(organization_id, k)`` each numbered pair of characters and character is. Normalised keys are of letters a-z,
    digits and spaces, so there are at most 1,406 of them for each repetition within a text."""
    every = reduce(DataFrame.unionByName, (t.select("k") for t in texts))
    grams = _split(every).select(F.array_sort(F.concat("pairs", F.when(F.length("k") > 0, F.col("single")).otherwise(F.split("k", "")))).alias("grams"))
    return grams.select(F.explode(_numbered("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


#: Up to so many keys a text and length of the other one, texts meet by two or three shared pairs of characters at once.
MOST_KEYS = 200


def _shared(n: Column, other: Column, least: float) -> tuple[Column, Column]:
    """How many characters two texts of these lengths and a ratio of ``least`` or more share in order, and how many pairs (``signatures``)."""
    m = F.ceil((n + other) * least / 2 - 1e-9)
    return m, 3 * m - n - other - 1


def _at_once(n: Column, other: Column, least: float) -> Column:
    """How many shared pairs of characters, up to three, are a key of two texts of these lengths; 1 leaves them to ``signatures``."""
    _, shared = _shared(n, other, least)
    rest = F.greatest(n, other) - 1 - shared
    return F.when((shared >= 3) & ((rest + 3) * (rest + 2) * (rest + 1) <= 6 * MOST_KEYS), 3).when((shared >= 2) & ((rest + 2) * (rest + 1) <= 2 * MOST_KEYS), 2).otherwise(1)


def combined(texts: DataFrame, order: DataFrame, lengths: DataFrame, least: float) -> DataFrame:
    """``organization_id, k, n, other, key``: two or three of the rarest pairs of characters of ``texts(organization_id, k)`` as one key, for each of the other
    side's ``lengths(organization_id, other)`` that the ratio allows and ``_at_once`` says.

    Of g pairs of which o are shared, any g - o + c hold c shared ones, so texts of that ratio have a key in common. Keys are hashes: equal ones
    of different pairs only bring more texts together."""
    n, other = F.col("n"), F.col("other")
    ranked = _split(texts.where(F.length("k") > 2)).select(ORG, "k", F.explode(_numbered("pairs")).alias("gram")).join(F.broadcast(order), "gram", "left")
    own = ranked.groupBy(ORG, "k").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))), lambda x: x["gram"]).alias("grams")).withColumn("n", F.length("k"))
    met = own.join(F.broadcast(lengths), ORG).where((F.least(n, other) * 2 >= (n + other) * least - 1e-9) & (_at_once(n, other, least) > 1)).withColumn("c", _at_once(n, other, least))
    # a few texts make many keys: they are dealt out by a fixed number, which is not folded again
    met = met.withColumn("g", F.slice("grams", 1, (n - 1 - _shared(n, other, least)[1] + F.col("c")).cast("int"))).drop("grams")
    met = met.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")
    behind = lambda i: F.slice("g", i, F.size("g"))
    two = F.flatten(F.transform("g", lambda x, i: F.transform(behind(i + 2), lambda y: F.xxhash64(x, y))))
    three = F.flatten(F.transform("g", lambda x, i: F.flatten(F.transform(behind(i + 2), lambda y, j: F.transform(behind(i + j + 3), lambda z: F.xxhash64(x, y, z))))))
    return met.select(ORG, "k", "n", "other", F.explode(F.when(F.col("c") == 3, three).otherwise(two)).alias("key"))


def close_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct ``organization_id, ka, kb`` of distinct texts ``(organization_id, k)``: all pairs of a ratio of ``least`` or more and some others,
    that share rare pairs of characters and whose lengths and edit distance allow the ratio. Pairs are judged where they meet, before any is
    written or dealt out."""
    if least <= 2 / 3:
        raise ValueError("texts of such a ratio need not share a pair of characters")
    left, right = written(left, "asked"), written(right, "known")  # each is read by its signatures and for the order
    order = rarity(left, right)
    lengths = {x: t.select(ORG, F.length("k").alias("other")).distinct() for t, x in ((left, "a"), (right, "b"))}
    named = lambda df, x: df.withColumnsRenamed({"k": f"k{x}", "n": f"n{x}"})
    na, nb = F.col("na"), F.col("nb")
    # a common subsequence of m characters leaves at most the others to be edited
    fits = (F.least(na, nb) * 2 >= (na + nb) * least - 1e-9) & (F.levenshtein("ka", "kb") <= na + nb - 2 * _shared(na, nb, least)[0])
    a, b = (named(combined(t, order, lengths[of], least), x) for t, x, of in ((left, "a", "b"), (right, "b", "a")))
    several = a.join(b.withColumnRenamed("other", "other_b"), (a[ORG] == b[ORG]) & (a["key"] == b["key"]) & (a["na"] == F.col("other_b")) & (a["other"] == b["nb"])).select(a[ORG], "ka", "kb", "na", "nb")

    def alone(t: DataFrame, of: str) -> DataFrame:
        n = F.length("k")
        some = F.broadcast(lengths[of]).groupBy(ORG).agg(F.collect_set("other").alias("others"))
        near = F.exists("others", lambda o: (F.least(n, o) * 2 >= (n + o) * least - 1e-9) & (_at_once(n, o, least) == 1))
        return signatures(t.join(F.broadcast(some), ORG).where(near).select(ORG, "k"), order, least)

    a, b = named(alone(left, "b"), "a"), named(alone(right, "a"), "b")
    single = a.join(b, [ORG, "gram"]).where(_at_once(na, nb, least) == 1).select(ORG, "ka", "kb", "na", "nb")
    return several.unionByName(single).where(fits).select(ORG, "ka", "kb").distinct()


#: From this ratio on possible matches are found by their rare pairs of characters.
CLOSE = 0.775


def similar(left: DataFrame, right: DataFrame, top: int = 3, score=None, group: str | None = None, least: float | None = None, key=norm_key) -> DataFrame:
    """The ``top`` right rows for each left row by similarity of the text normalised by ``key``: ``left(organization_id, left_id, text)``,
    ``right(organization_id, right_id, text)``, ties to smaller ids. Each distinct pair of texts is compared once. ``score`` takes the two
    texts' columns; the default is the ratio, without ``least`` to 2 decimals. With ``group`` a right id counts once, by its best text.

    With ``least``, above 2/3, only ratios from it on count, and texts meet by their rarest pairs of characters (``close_pairs``). Without it
    texts that share three characters in a row are compared; by ratio, only those for which the rare pairs did not find ``top`` rows
    of a score that all others stay below."""
    a = left.select(ORG, "left_id", key(F.col("text")).alias("k"))
    b = right.select(ORG, "right_id", key(F.col("text")).alias("k")).distinct()
    asked, known = a.select(ORG, "k").distinct(), b.select(ORG, "k").distinct()
    ids = b.withColumn("r", F.row_number().over(Window.partitionBy(ORG, "k").orderBy("right_id"))).where(F.col("r") <= top).drop("r")  # more rows of one text cannot be among the top
    rank = F.row_number().over(Window.partitionBy(ORG, "ka").orderBy(F.col("score").desc(), "right_id"))

    def ranked(met: DataFrame) -> DataFrame:
        value = score(F.col("ka"), F.col("kb")) if score else similarity("ka", "kb")
        each = met.withColumn("score", value if score or least else F.round(value, 2)).join(ids.withColumnRenamed("k", "kb"), [ORG, "kb"])
        if group:
            each = each.groupBy(ORG, "ka", group).agg(F.max("score").alias("score"))
        return each.withColumn("rank", rank).where(F.col("rank") <= top).select(ORG, "ka", "right_id", "score", "rank")

    def sharing(texts: DataFrame) -> DataFrame:
        return _grams(texts).withColumnRenamed("k", "ka").join(_grams(known).withColumnRenamed("k", "kb"), [ORG, "g"]).select(ORG, "ka", "kb").distinct()

    if least is not None:
        best = ranked(close_pairs(asked, known, least)).where(F.col("score") >= least)
    elif score:
        best = ranked(sharing(asked))
    else:
        found = written(ranked(close_pairs(asked, known, CLOSE)), "close")
        settled = found.where((F.col("rank") == top) & (F.col("score") >= round(CLOSE + 0.005, 3))).select(ORG, F.col("ka").alias("k"))
        best = found.join(settled.withColumnRenamed("k", "ka"), [ORG, "ka"], "left_semi").unionByName(ranked(sharing(asked.join(settled, [ORG, "k"], "left_anti"))))
    return a.withColumnRenamed("k", "ka").join(best, [ORG, "ka"]).select(ORG, "left_id", "right_id", "score", "rank")


def possible_suppliers(unmatched: DataFrame, suppliers: DataFrame, least: float = 0.78) -> DataFrame:
    """Of ``unmatched(organization_id, left_id, text)`` up to three suppliers of a name or alias with a ratio of ``least`` or more."""
    names = suppliers.select(ORG, F.col("supplier_id").alias("right_id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("text"))
    return similar(unmatched, names, 3, group="right_id", least=least, key=norm_supplier)


def sender_role(emails: DataFrame, users: DataFrame) -> DataFrame:
    """BUYER for addresses of own users, SUPPLIER for others, UNKNOWN without an address."""
    own = users.select(ORG, norm_email(F.col("email")).alias("_e")).distinct().withColumn("_own", F.lit(True))
    e = emails.withColumn("_e", norm_email(F.col("sender_email")))
    role = F.when(F.col("_e") == "", "UNKNOWN").when(F.col("_own"), "BUYER").otherwise("SUPPLIER")
    return e.join(own, [ORG, "_e"], "left").withColumn("sender_role", role).drop("_e", "_own")


def propose_suppliers(matches: DataFrame) -> DataFrame:
    """For ``matches(organization_id, left_id, method, email, name)`` what to do: a known supplier's new contact is added when domain, alias or
    name matched; the unmatched are proposed as new once a name, or reviewed if they write from a public mail domain."""
    generic = email_domain(F.col("email")).isin(*GENERIC_DOMAINS)
    action = F.when(F.col("method").isin("EXACT_VERIFIED_DOMAIN", "KNOWN_ALIAS", "NORMALIZED_NAME"), "ADD_CONTACT").when(F.col("method") == "EXACT_CONTACT_EMAIL", "NONE").when(F.col("method") != "NO_MATCH", "REVIEW").when(generic, "REVIEW").otherwise("NEW_UNVERIFIED")
    out = matches.withColumn("action", action).withColumn("key", norm_supplier(F.col("name")))
    first = F.row_number().over(Window.partitionBy(ORG, "action", "key").orderBy("left_id"))
    return out.withColumn("proposed", (F.col("action") == "NEW_UNVERIFIED") & (first == 1)).drop("key")


def confirmed_mappings(current: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``(organization_id, supplier_id, supplier_sku) -> item_id`` after reviewed lines, which overwrite; of several the last review counts."""
    old = current.select(ORG, "supplier_id", "supplier_sku", "item_id", F.lit(None).cast("timestamp").alias("reviewed_at"))
    new = reviewed.where("item_id is not null and supplier_sku is not null").select(*old.columns)
    when = F.struct(F.coalesce("reviewed_at", F.lit("0001-01-01").cast("timestamp")), "item_id")
    return old.unionByName(new).groupBy(ORG, "supplier_id", "supplier_sku").agg(F.max_by("item_id", when).alias("item_id"))
