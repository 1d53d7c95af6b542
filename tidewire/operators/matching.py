"""Entity resolution: each article against a snapshot of all open dossiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.signals import FAVORABLE, PROXIMITY_DAYS, UNFAVORABLE, compare, enrichment_type, exclusive, named, novel_keys, tier_rank, with_signals
from tidewire.functions.text import collapse
from tidewire.operators import candidates
from tidewire.operators.common import few
from tidewire.storage import materialize

DAY = 86_400_000
#: The reference takes so many candidates at most; only queries whose SQL does so as well ask for it.
CANDIDATES = 500
#: Up to so many candidates resolve() compares as rows of bits, more of them in numpy.
FEW = 512


def candidate_folders(folders: DataFrame, most: int | None = None) -> DataFrame:
    """All open or idle dossiers, or the so many most recently active of them."""
    live = folders.filter(F.col("status").isin("open", "idle"))
    return live if most is None else live.orderBy(F.desc("last_activity"), "folder_id").limit(most)


def folder_fingerprints(folders: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """Fingerprint of each folder from its articles (with signals) in the order they were attached: sets are united, of scalars the first that is not null counts, tier and nature are the first article's."""
    own = members.join(articles, "article_id").select("folder_id", F.struct("attached_at", "article_id").alias("at"), "*")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    merged = own.groupBy(members["folder_id"]).agg(
        union("entities").alias("entities"), union("labels").alias("labels"), F.array_sort(F.collect_set("canonical")).alias("urls"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("facts.key"))))).alias("keys"), first("product").alias("product"), first("version").alias("version"),
        F.min_by("nature", "at").alias("nature"), F.min_by("source_tier", "at").alias("tier"), first("published_at").alias("date"),
    )
    none = F.array().cast("array<string>")
    joined = folders.join(merged, "folder_id", "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("entities", "labels", "urls", "keys")})


def _tokens(urls: Column, entities: Column, labels: Column) -> Column:
    mark = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind), x))
    return F.explode(F.array_distinct(F.concat(mark("u", urls), mark("e", entities), mark("c", labels))))


def _shared(articles: DataFrame, numbered: DataFrame, words: int) -> DataFrame:
    """(article_id, url, ent, cat): which candidates share a URL, an entity or a label with an article, as a bit for each candidate in 64-bit words. An inverted index of the candidates meets each token of an article once, however many candidates have it."""
    held = numbered.select("word", "mask", _tokens(F.col("urls"), F.col("entities"), F.col("labels")).alias("token"))
    columns = [f"w{w}" for w in range(words)]
    index = materialize(held.groupBy("token").agg(*(F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("mask"))), F.lit(0).cast("long")).alias(c) for w, c in enumerate(columns))))
    none = F.array().cast("array<string>")
    own = articles.select("article_id", _tokens(F.when(F.col("canonical").isNotNull(), F.array("canonical")).otherwise(none), F.col("entities"), F.col("labels")).alias("token"))
    met = own.join(few(index), "token").groupBy("article_id")
    of = lambda kind: F.array(*(F.coalesce(F.bit_or(F.when(F.col("token").startswith(kind), F.col(c))), F.lit(0).cast("long")) for c in columns))
    return met.agg(of("u").alias("url"), of("e").alias("ent"), of("c").alias("cat"))


def _numbered(fingerprints: DataFrame) -> DataFrame:
    """The candidates that are not closed with place, from 0 in the order of folder_id, and their bit (mask) of 64-bit words (word). Sorted in parts, which are counted; no task sorts all."""
    live = fingerprints.filter("status <> 'closed'")
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = materialize(live.repartitionByRange("folder_id").sortWithinPartitions("folder_id").withColumns({"part": F.spark_partition_id(), "inner": inner}))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("start"))
    placed = parts.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("inner")).drop("part", "inner", "start")
    return materialize(placed.withColumns({"word": F.floor(F.col("place") / 64).cast("int"), "mask": F.expr("shiftleft(1L, cast(place % 64 as int))")}))


def _compared(articles: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """article_id, folder_id, blocked, level, favorable and unfavorable (as bits) of every pair, over scalars alone."""
    numbered = _numbered(fingerprints)
    words = max(1, -(-numbered.count() // 64))
    f = numbered.select(F.struct("folder_id", "product", "nature", "version", "date", "tier", (F.size("entities") > 0).alias("some"), "word", "mask").alias("f"))
    enough = articles.filter("primary")
    slim = enough.select("article_id", "product", "nature", "version", F.col("published_at").alias("date"), F.col("source_tier").alias("tier"), (F.size("entities") > 0).alias("some"))
    both = slim.join(_shared(enough, numbered, words), "article_id", "left").join(F.broadcast(f))
    bit = lambda c: F.coalesce(F.get(c, F.col("f.word")).bitwiseAND(F.col("f.mask")) != 0, F.lit(False))
    flagged = both.withColumns({"url": bit("url"), "ent": bit("ent"), "cat": bit("cat")})
    keys = ("product", "nature", "version", "date", "tier", "some")
    found = compare({k: F.col(k) for k in keys}, {k: F.col(f"f.{k}") for k in keys}, F.col("url"), F.col("ent"), F.col("cat"))
    return flagged.select("article_id", F.col("f.folder_id").alias("folder_id"), *(c.alias(k) for k, c in found.items()))


def pairs(articles: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Every article with signals and enough content against every candidate that is not closed, with all it shows: for few candidates, as each pair is a row; see counted() and resolve()."""
    own = articles.select("article_id", F.col("facts.key").alias("own_keys"))
    known = fingerprints.select("folder_id", F.col("keys").alias("known_keys"))
    wide = _compared(articles, fingerprints).join(own, "article_id").join(few(known), "folder_id")
    return wide.select("article_id", "folder_id", "blocked", "level", named(F.col("favorable"), FAVORABLE).alias("favorable"), named(F.col("unfavorable"), UNFAVORABLE).alias("unfavorable"), novel_keys(F.col("own_keys"), F.col("known_keys")).alias("novel"))


def decide(articles: DataFrame, compared: DataFrame) -> DataFrame:
    """issue, folder_id, confidence, motives, favorable, unfavorable, facts, enrichment and title of each article, from pairs().

    Thin content comes first, then a tie of the best folders, the best folder (with or without novel facts), a weak match, and
    a new dossier last. One grouped aggregate over the pairs; no pair is sorted.
    """
    attach, low = F.col("level") >= 2, F.col("level") == 1
    best = F.struct((-F.col("level")).alias("l"), "folder_id", "favorable", "unfavorable", "novel")
    own = compared.groupBy("article_id").agg(
        F.min(F.when(attach, best)).alias("top"), F.count_if(F.col("level") == 3).alias("n3"), F.count_if(F.col("level") == 2).alias("n2"), F.min(F.when(low, best)).alias("weak"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("level") == 3, F.col("favorable")))))).alias("f3"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("level") == 2, F.col("favorable")))))).alias("f2"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("blocked"), F.col("unfavorable")))))).alias("barred"), F.bool_or("blocked").alias("any_blocked"),
    )
    return _outcome(articles.join(own, "article_id", "left"))


def counted(articles: DataFrame, fingerprints: DataFrame, size: int = candidates.BLOCK) -> DataFrame:
    """level, favorable, unfavorable, pairs, novel: of pairs(), how many show the same, and how many facts are novel in these; no pair is made. Candidates are taken in blocks of a size."""
    numbered = _numbered(fingerprints)
    found = candidates.counted(articles.filter("primary"), numbered, numbered.count(), size)
    total = found.groupBy("level", "favorable", "unfavorable").agg(F.sum("pairs").alias("pairs"), F.sum("novel").alias("novel"))
    return total.withColumns({"favorable": named(F.col("favorable"), FAVORABLE), "unfavorable": named(F.col("unfavorable"), UNFAVORABLE)})


def _levels(articles: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bits, names): of each article and word of 64 candidates, which of them are on each level and what speaks for and against them, a bit for each candidate; and the folder_id of each place.

    What a candidate's scalars say to an article depends on the value of the article's alone, so it is found once a value, as
    bits, and looked up: an article takes a row for each word, not for each candidate, and no pair is ever made.
    """
    return _levels_of(articles, _numbered(fingerprints))


def _levels_of(articles: DataFrame, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    words = max(1, -(-numbered.count() // 64))
    f = numbered.select("word", "mask", F.struct("product", "nature", "version", F.col("tier").alias("tier"), (F.size("entities") > 0).alias("some")).alias("f"), "date")
    bits = lambda cond: F.coalesce(F.bit_or(F.when(cond, F.col("mask"))), F.lit(0).cast("long"))
    true = lambda c: F.coalesce(c, F.lit(False))

    def of(name: str, values: DataFrame, **conds) -> DataFrame:
        """Bits of the candidates for which each condition holds, by the value v of an article's column and by word."""
        return F.broadcast(values.select(F.col(name).alias("v")).distinct().crossJoin(F.broadcast(f)).groupBy("v", "word").agg(*(bits(true(c)).alias(k) for k, c in conds.items())))

    enough = articles.filter("primary")
    every = numbered.groupBy("word").agg(F.bit_or("mask").alias("every"), bits(F.size("entities") > 0).alias("f_some"), bits(F.col("product").isNotNull() | F.col("version").isNotNull()).alias("f_anchored"), bits(F.col("product").isNotNull()).alias("f_product"), bits(F.col("version").isNotNull()).alias("f_version"))
    v = F.col("v")
    same = lambda name: F.broadcast(numbered.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v"), "word").agg(F.bit_or("mask").alias(f"same_{name}")))
    natures = of("nature", enough, same_nature=(v == F.col("f.nature")) & (v != "other"), apart=exclusive(v, F.col("f.nature")))
    tiers = of("source_tier", enough, higher=tier_rank(v) > tier_rank(F.col("f.tier")))
    # between two neighbouring dates at which a candidate begins or ceases to be near, the same ones are; a stretch is cut by day, so that an article looks through those of its own
    reach = PROXIMITY_DAYS * DAY
    dated = f.filter("date is not null").select("word", "mask", "date")
    starts = dated.select(F.explode(F.array(F.col("date") - reach, F.col("date") + reach + 1)).alias("since")).distinct()
    spans = starts.withColumn("until", F.lead("since").over(Window.orderBy("since"))).filter("until is not null")
    spans = spans.join(F.broadcast(dated), F.abs(F.col("since") - F.col("date")) <= reach).groupBy("since", "until", "word").agg(F.bit_or("mask").alias("near"))
    day = lambda c: F.floor(c / DAY).cast("long")
    near = F.broadcast(materialize(spans.withColumn("day", F.explode(F.sequence(day(F.col("since")), day(F.col("until") - 1))))).withColumnRenamed("word", "near_word"))
    shared = _shared(enough, numbered, words)
    slim = enough.select("article_id", "product", "nature", "version", "published_at", "source_tier", (F.size("entities") > 0).alias("some")).join(shared, "article_id", "left").join(F.broadcast(every))

    def looked(rows: DataFrame, table: DataFrame, name: str) -> DataFrame:
        t = table.withColumnRenamed("word", "t_word")
        return rows.join(t, (rows[name] == t["v"]) & (rows["word"] == t["t_word"]), "left").drop("v", "t_word")

    e = slim
    for table, name in ((same("product"), "product"), (same("version"), "version"), (natures, "nature"), (tiers, "source_tier")):
        e = looked(e, table, name)
    e = e.join(near, (day(F.col("published_at")) == near["day"]) & (e["word"] == near["near_word"]) & (e["published_at"] >= near["since"]) & (e["published_at"] < near["until"]), "left")
    zero = F.lit(0).cast("long")
    held = e.select("article_id", "word", "every", "f_some", "f_anchored", "f_product", "f_version", "product", "version", "some", *(F.coalesce(c, zero).alias(c) for c in ("same_product", "same_version", "same_nature", "apart", "higher", "near")), *(F.coalesce(F.get(c, F.col("word")), zero).alias(c) for c in ("url", "ent", "cat")))
    both = lambda x, *more: reduce(lambda y, z: y.bitwiseAND(z), more, x)
    some = lambda x, *more: reduce(lambda y, z: y.bitwiseOR(z), more, x)
    c, no = F.col, lambda x: both(F.col("every"), F.bitwise_not(x))
    url, ent, cat, prod, ver, nat, close = c("url"), c("ent"), c("cat"), c("same_product"), c("same_version"), c("same_nature"), c("near")
    anchored = F.when(c("product").isNotNull() | c("version").isNotNull(), c("every")).otherwise(c("f_anchored"))
    others = F.when(c("some"), both(no(ent), c("f_some"), no(prod), anchored)).otherwise(zero)
    product = F.when(c("product").isNotNull(), both(c("f_product"), no(prod))).otherwise(zero)
    release = F.when(c("version").isNotNull(), both(c("f_version"), no(ver))).otherwise(zero)
    h = held.withColumns({"others": others, "other_product": product, "other_release": release})
    h = h.withColumn("blocked", some(c("others"), c("other_product"), c("other_release"), c("apart")))
    h = h.withColumns({"strong": some(url, both(ent, nat, ver), both(prod, nat, ver), both(ent, ver, prod)), "medium": some(both(ent, nat), both(ent, ver), both(prod, nat, close), url), "weak": some(ent, prod, cat, close), "open": no(c("blocked"))})
    h = h.withColumns({"l3": both(c("open"), c("strong")), "l2": both(c("open"), no(c("strong")), c("medium")), "l1": both(c("open"), no(c("strong")), no(c("medium")), c("weak"))})
    h = h.withColumn("vague", both(c("l1"), no(some(ent, prod, nat, ver, url))))
    return h, _names(numbered)


def _names(numbered: DataFrame) -> DataFrame:
    return numbered.select("place", F.col("folder_id").alias("place_id"), F.col("keys").alias("place_keys"))


#: The columns of _levels() whose bits stand for FAVORABLE and UNFAVORABLE, in their order.
_FOR, _AGAINST = ("cat", "higher", "same_nature", "url", "ent", "same_product", "same_version", "near"), ("others", "other_product", "other_release", "apart", "vague", "vague")


def resolve(articles: DataFrame, fingerprints: DataFrame, most: int = FEW, size: int = candidates.BLOCK) -> DataFrame:
    """decide() over all pairs, of which none is made: candidates are compared 64 at a time, as bits, and names and novel facts are only built for the folders that come out best. Up to so many candidates the bits are columns, more are compared in numpy, in blocks of a size."""
    numbered = _numbered(fingerprints)
    many = numbered.count()
    wide, names = _ranked(*_levels_of(articles, numbered)) if many <= most else (candidates.best(articles.filter("primary"), numbered, many, size), _names(numbered))
    c = F.col
    own = wide.groupBy("article_id").agg(*(F.min(f"b{k}").alias(f"b{k}") for k in (1, 2, 3)), F.sum("k3").alias("n3"), F.sum("k2").alias("n2"), *(F.bit_or(k).alias(k) for k in ("f3", "f2", "barred")), F.bool_or("any_blocked").alias("any_blocked"))
    own = own.withColumns({"t": F.coalesce("b3", "b2"), "w": c("b1"), "tl": F.when(c("b3").isNotNull(), -3).otherwise(-2)})
    at = lambda b: F.shiftright(b, 14).cast("long")
    known = lambda p: few(names.select(c("place").alias(f"{p}_place"), c("place_id").alias(f"{p}_id"), c("place_keys").alias(f"{p}_keys")))
    e = articles.join(own, "article_id", "left").join(known("t"), at(c("t")) == c("t_place"), "left").join(known("w"), at(c("w")) == c("w_place"), "left")
    spelt = lambda b, level, more: F.when(c(b).isNotNull(), F.struct(level.alias("l"), c(f"{b}_id").alias("folder_id"), named(F.shiftright(b, 6).bitwiseAND(F.lit(255)), FAVORABLE).alias("favorable"), named(c(b).bitwiseAND(F.lit(63)), UNFAVORABLE).alias("unfavorable"), more.alias("novel")))
    listed = lambda b, all_: F.when(c(b).isNotNull(), named(c(b), all_))
    return _outcome(e.withColumns({"top": spelt("t", c("tl"), novel_keys(F.col("facts.key"), F.col("t_keys"))), "weak": spelt("w", F.lit(-1), F.array().cast("array<string>")), "f3": listed("f3", FAVORABLE), "f2": listed("f2", FAVORABLE), "barred": listed("barred", UNFAVORABLE)}))


def _ranked(held: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_levels() with the first candidate of each level by word, how many are on it and what they show together, as candidates.BEST."""
    c = F.col
    last = F.lit(-(1 << 63))  # the 64th bit alone, of which there is no negative
    lowest = lambda m: F.when(m == last, m).otherwise(m.bitwiseAND(-m))
    index = lambda m: F.when(m == last, 63).otherwise(F.bit_count(m.bitwiseAND(-m) - 1))
    flags = lambda m, kinds: reduce(lambda x, y: x + y, (F.when(m.bitwiseAND(c(k)) != 0, 1 << i).otherwise(0) for i, k in enumerate(kinds)))
    # one number for the best candidate of a word, the smallest first: its place (the order of folder_id), then its bits for and against
    one = lambda m: F.when(m != 0, (c("word") * 64 + index(m)).cast("long") * (1 << 14) + flags(lowest(m), _FOR) * (1 << 6) + flags(lowest(m), _AGAINST))
    of = lambda m, kinds: F.when(m != 0, flags(m, kinds))
    wide = held.select("article_id", *(one(c(k)).alias(f"b{k[1]}") for k in ("l1", "l2", "l3")), *(F.bit_count(k).cast("long").alias(f"k{k[1]}") for k in ("l2", "l3")), of(c("l3"), _FOR).alias("f3"), of(c("l2"), _FOR).alias("f2"), of(c("blocked"), _AGAINST).alias("barred"), (c("blocked") != 0).alias("any_blocked"))
    return wide, names


def _outcome(e: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    tied = F.when(F.col("n3") > 0, F.col("n3") > 1).otherwise(F.coalesce(F.col("n2") > 1, F.lit(False)))
    tied_favorable = F.when(F.col("n3") > 0, F.col("f3")).otherwise(F.col("f2"))
    has_top, has_weak = F.col("top").isNotNull(), F.col("weak").isNotNull()
    novel = F.size("top.novel") > 0
    when = lambda thin, tie, new, old, weak, create: F.when(~F.col("primary"), thin).when(has_top & tied, tie).when(has_top & novel, new).when(has_top, old).when(has_weak, weak).otherwise(create)
    lit, level = F.lit, F.when(F.col("top.l") == -3, "high").otherwise("medium")
    one = lambda *xs: F.array(*(F.lit(x) for x in xs))
    add = lambda xs, x: F.array_sort(F.array_distinct(F.concat(xs, one(x))))
    blocked = F.coalesce("any_blocked", lit(False))
    return e.select(
        "article_id",
        when(lit("ambiguous_no_action"), lit("ambiguous_no_action"), lit("attach_enrich"), lit("duplicate_editorial"), lit("ambiguous_no_action"), lit("create_dossier")).alias("issue"),
        when(lit(None), lit(None), F.col("top.folder_id"), F.col("top.folder_id"), F.col("weak.folder_id"), lit(None)).alias("folder_id"),
        when(lit("low"), lit("low"), level, level, lit("low"), lit("none")).alias("confidence"),
        when(one("insufficient_primary_information"), one("multiple_plausible_folders"), one("same_event", "novel_information"), one("same_event", "no_novel_information"), one("low_confidence_match"), F.when(blocked, one("distinct_event", "primary_information")).otherwise(one("no_credible_candidate", "primary_information"))).alias("motives"),
        when(none, tied_favorable, F.col("top.favorable"), F.col("top.favorable"), F.col("weak.favorable"), none).alias("favorable"),
        when(one("content_too_thin"), one("conflicting_candidate_folders"), F.col("top.unfavorable"), add(F.col("top.unfavorable"), "absence_of_new_value"), add(F.col("weak.unfavorable"), "insufficient_event_identity"), F.coalesce("barred", none)).alias("unfavorable"),
        when(none, none, F.col("top.novel"), none, none, none).alias("facts"),
        when(lit(None), lit(None), enrichment_type(F.col("nature"), F.col("top.novel")), lit(None), lit(None), lit(None)).alias("enrichment"),
        when(lit(None), lit(None), lit(None), lit(None), lit(None), collapse(F.col("title"))).alias("title"),
    )


def justification(decisions: DataFrame) -> DataFrame:
    """decisions with the line that explains each."""
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ","), F.lit("")), F.lit("none"))
    part = lambda name, c: F.concat(F.lit(f"{name}="), c)
    return decisions.withColumn("justification", F.concat_ws("; ", part("issue", F.col("issue")), part("confidence", F.col("confidence")), part("folder", F.coalesce("folder_id", F.lit("none"))), part("motives", F.array_join("motives", ",")), part("favorable", listed("favorable")), part("unfavorable", listed("unfavorable"))))


def violations(decisions: DataFrame, folders: DataFrame) -> DataFrame:
    """Decisions (article_id, issue, folder_id, title) that cannot be stored, and why: a dossier without a title, a match without a dossier, or with one that is absent or closed."""
    state = folders.select("folder_id", "status")
    e = decisions.join(state, "folder_id", "left")
    matched = F.col("issue").isin("attach_enrich", "duplicate_editorial")
    broken = (
        F.when((F.col("issue") == "create_dossier") & (F.coalesce("title", F.lit("")) == ""), "title_missing")
        .when(matched & F.col("folder_id").isNull(), "folder_missing")
        .when((F.col("issue") == "attach_enrich") & F.col("status").isNull(), "folder_absent")
        .when((F.col("issue") == "attach_enrich") & (F.col("status") == "closed"), "folder_closed")
        .when(~F.col("issue").isin("create_dossier", "attach_enrich", "duplicate_editorial", "ambiguous_no_action"), "issue_unknown")
    )
    return e.withColumn("broken", broken).filter("broken is not null").select("article_id", "issue", "folder_id", "broken")


def attach_effects(decisions: DataFrame, folders: DataFrame, decided_at: int) -> DataFrame:
    """The folders (folder_id, status, last_activity) after a cycle: those that an article was attached to are active now, and open if they were idle; closed ones stay as they are."""
    touched = decisions.filter("issue = 'attach_enrich'").select("folder_id", F.lit(True).alias("touched")).distinct()
    live = F.coalesce("touched", F.lit(False)) & (F.col("status") != "closed")
    joined = folders.join(touched, "folder_id", "left")
    return joined.select("folder_id", F.when(live & (F.col("status") == "idle"), "open").otherwise(F.col("status")).alias("status"), F.when(live, F.lit(decided_at)).otherwise(F.col("last_activity")).alias("last_activity"))


def match(articles: DataFrame, fingerprints: DataFrame) -> DataFrame:
    return resolve(with_signals(articles), fingerprints)


def skipped(articles: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Articles that are not to be matched (again), with the reason: a membership counts before a decision."""
    member = members.select("article_id", F.lit(True).alias("member")).distinct()
    decided = decisions.select("article_id", F.lit(True).alias("decided")).distinct()
    reason = F.when(F.col("member"), "already_processed").when(F.col("decided"), "terminal_state")
    return articles.join(member, "article_id", "left").join(decided, "article_id", "left").withColumn("reason", reason).filter("reason is not null").drop("member", "decided")


def unprocessed(articles: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Articles without membership and without decision."""
    return articles.join(members, "article_id", "left_anti").join(decisions, "article_id", "left_anti")


def persist(decisions: DataFrame, decided_at: int) -> tuple[DataFrame, DataFrame]:
    """New dossiers and memberships of a cycle's decisions (article_id, issue, folder_id, title, enrichment, facts); ids of dossiers derive from article and time, so a repeated cycle makes the same ones."""
    made = F.sha2(F.concat_ws(":", "article_id", F.lit(str(decided_at))), 256)
    new, more = decisions.filter("issue = 'create_dossier'"), decisions.filter("issue = 'attach_enrich'")
    folders = new.select(made.alias("folder_id"), F.lit("open").alias("status"), "title", F.lit(decided_at).alias("last_activity"))
    none = F.lit(None)
    first = new.select(made.alias("folder_id"), "article_id", F.lit("primary").alias("role"), F.lit(decided_at).alias("attached_at"), none.cast("string").alias("enrichment"), none.cast(decisions.schema["facts"].dataType).alias("facts"))
    return folders, first.unionByName(more.select("folder_id", "article_id", F.lit("enrichment").alias("role"), F.lit(decided_at).alias("attached_at"), "enrichment", "facts"))
