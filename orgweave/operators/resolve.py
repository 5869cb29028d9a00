"""From extraction records to clients: merge by name, reconcile with links, attach domains, learned rules.

Records have ``agency, seq, client_name, client_domain, source, confidence, method, derived``; ``seq`` orders
the records of an agency. All grouping is by (agency, name key); pairs of named and linked clients are
compared within an agency by the blocking keys that the brand predicate implies, never all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgweave.functions.names import match_forms, name_key, same_brand, squash, tokens
from orgweave.functions.urls import blank_to_null, root_domain
from orgweave.operators.scoring import level_rank
from orgweave.operators.upsert import earliest_value
from orgweave.staging import stage


def _level(rank: Column) -> Column:
    return F.when(rank == 0, "high").when(rank == 1, "medium").otherwise("low")


def merge_records(records: DataFrame) -> DataFrame:
    """One client a (agency, name key): best confidence with its source, first domain, longest written name
    (earliest on ties; the seed's if all are derived), sorted methods. Records without a key are dropped."""
    r = records.withColumn("key", name_key("client_name")).filter("key <> ''").withColumn("rank", level_rank(F.col("confidence")))
    written = F.when(~F.col("derived"), F.struct((-F.length("client_name")).alias("l"), "seq", F.col("client_name").alias("n")))
    return r.groupBy("agency", "key").agg(
        F.min("seq").alias("seq"), F.min(F.struct("rank", "seq", "source")).alias("_b"),
        earliest_value(F.col("client_domain"), F.col("seq")).alias("client_domain"), F.min(written).alias("_w"),
        F.min_by("client_name", "seq").alias("_first"), F.array_sort(F.collect_set("method")).alias("methods"),
    ).select(
        "agency", "key", "seq", F.coalesce(F.col("_w.n"), F.col("_first")).alias("client_name"), "client_domain",
        F.col("_b.rank").alias("rank"), F.col("_b.source").alias("source"), "methods", F.col("_w").isNull().alias("derived"),
    )


def _blocks(name: Column, stem: Column | None) -> Column:
    """Keys one of which two strings of the same brand must share: their first six squashed characters
    (or the whole of a shorter one), and each pair of tokens."""
    s = squash(name)
    t = F.array_sort(F.array_distinct(tokens(stem if stem is not None else name)))
    pairs = F.flatten(F.transform(t, lambda a: F.transform(F.filter(t, lambda b: b > a), lambda b: F.concat(a, F.lit(" "), b))))
    return F.array_distinct(F.concat(F.array(F.substring(s, 1, 6)), pairs))


def reconcile(clients: DataFrame) -> DataFrame:
    """Fold each client without a domain into the first linked client of its agency that is the same brand.

    The written, fuller name wins, methods are united, the better confidence is kept; the folded row goes.
    """
    stem = F.substring_index(F.col("client_domain"), ".", 1)
    linked = clients.filter("client_domain IS NOT NULL")
    named = clients.filter("client_domain IS NULL")
    a = named.select("agency", F.col("seq").alias("n_seq"), F.col("client_name").alias("n_name"), F.col("methods").alias("n_methods"),
                     F.col("rank").alias("n_rank"), F.explode(_blocks(F.col("client_name"), None)).alias("_b"))
    b = linked.select("agency", "seq", "client_domain", F.explode(_blocks(stem, stem)).alias("_b"))
    hits = a.join(b, ["agency", "_b"]).filter(same_brand("n_name", "client_domain"))
    first = hits.groupBy("agency", "n_seq").agg(F.min("seq").alias("seq"), F.first("n_name").alias("n_name"),
                                                F.first("n_methods").alias("n_methods"), F.first("n_rank").alias("n_rank"))
    folded = first.groupBy("agency", "seq").agg(
        F.array_sort(F.collect_list(F.struct("n_seq", "n_name"))).alias("_names"), F.min("n_rank").alias("_rank"),
        F.array_distinct(F.flatten(F.collect_list("n_methods"))).alias("_methods"),
    )
    j = linked.join(folded, ["agency", "seq"], "left")
    start = F.struct(F.col("client_name").alias("name"), F.col("derived").alias("derived"))

    def step(acc: Column, x: Column) -> Column:
        fuller = F.startswith(squash(x["n_name"]), squash(acc["name"])) & (F.length(x["n_name"]) > F.length(acc["name"]))
        take = acc["derived"] | fuller
        return F.struct(F.when(take, x["n_name"]).otherwise(acc["name"]).alias("name"), F.when(take, F.lit(False)).otherwise(acc["derived"]).alias("derived"))

    j = j.withColumn("_f", F.coalesce(F.aggregate(F.col("_names"), start, step), start))
    merged = j.select(
        "agency", "key", "seq", F.col("_f.name").alias("client_name"), "client_domain", F.least("rank", F.coalesce("_rank", "rank")).alias("rank"),
        "source", F.array_sort(F.array_union("methods", F.coalesce("_methods", "methods"))).alias("methods"), F.col("_f.derived").alias("derived"),
    )
    left = named.join(first.select("agency", F.col("n_seq").alias("seq")), ["agency", "seq"], "left_anti").select(*merged.columns)
    return merged.unionByName(left)


def promote(clients: DataFrame) -> DataFrame:
    """Two methods lift medium to high; the source names the methods."""
    lift = (F.size("methods") > 1) & (F.col("rank") == 1)
    return clients.withColumn("rank", F.when(lift, 0).otherwise(F.col("rank"))).withColumn(
        "source", F.concat(F.array_join("methods", "+"), F.lit(" | "), F.col("source"))
    )


def attach_domains(clients: DataFrame) -> DataFrame:
    """A client without a domain takes that of the first linked one of its agency which shares its tokens:
    min(2, all) of them with the domain, or all of them with the name."""
    c = clients.withColumn("_k", F.array_sort(F.array_distinct(F.split(name_key("client_name"), " "))))
    toks = F.array_sort(F.array_distinct(tokens(F.substring_index(F.col("client_domain"), ".", 1))))
    linked = c.filter("client_domain IS NOT NULL").select("agency", F.struct("seq", F.col("client_domain").alias("d")).alias("_l"), "_k", toks.alias("_t"))

    # the predicate is equality of keys: the whole name, its one token, or a pair of its tokens
    def pairs(t: Column) -> Column:
        return F.flatten(F.transform(t, lambda a: F.transform(F.filter(t, lambda b: b > a), lambda b: F.concat(F.lit("2 "), a, F.lit(" "), b))))

    whole = F.concat(F.lit("= "), F.array_join("_k", " "))
    one = lambda t: F.transform(t, lambda x: F.concat(F.lit("1 "), x))
    theirs = linked.select("agency", "_l", F.explode(F.concat(F.array(whole), one(F.col("_t")), pairs(F.col("_t")))).alias("_key"))
    # of equal keys the first linked client counts, so a hot key is one row before the join
    theirs = theirs.groupBy("agency", "_key").agg(F.min("_l").alias("_l"))
    mine = F.concat(F.array(whole), F.when(F.size("_k") == 1, one(F.col("_k"))).otherwise(pairs(F.col("_k"))))
    named = c.filter("client_domain IS NULL").select("agency", "seq", F.explode(F.array_distinct(mine)).alias("_key"))
    hit = named.join(theirs, ["agency", "_key"]).groupBy("agency", "seq").agg(F.min("_l")["d"].alias("_d"))
    j = c.join(hit, ["agency", "seq"], "left").drop("_k")
    note = F.when(F.col("_d").isNotNull(), F.concat("source", F.lit(" | domain matched to "), "_d")).otherwise(F.col("source"))
    return j.withColumn("source", note).withColumn("client_domain", F.coalesce("client_domain", "_d")).drop("_d")


def apply_rules(clients: DataFrame, names: DataFrame, domains: DataFrame, junk: DataFrame, levels: DataFrame) -> DataFrame:
    """Learned corrections after merging: rename, then the domain by the new name, then junk, then levels.

    names (key, correct), domains (key, correct), junk (form, agency or NULL for everywhere), levels (method,
    level). Corrected rows are high; the others take the best learned level of their methods, if any.
    """
    n = names.select(F.col("key").alias("_nk"), F.col("correct").alias("_nc"))
    c = clients.withColumn("_k", name_key("client_name")).join(n, F.col("_k") == F.col("_nk"), "left")
    renamed = F.col("_nc").isNotNull() & (F.col("_nc") != F.col("client_name"))
    c = c.withColumn("_renamed", renamed).withColumn(
        "source", F.when(renamed, F.concat("source", F.lit(" | renamed from '"), "client_name", F.lit("' (your correction)"))).otherwise(F.col("source"))
    )
    c = c.withColumn("client_name", F.coalesce("_nc", "client_name")).drop("_nk", "_nc", "_k").withColumn("_k", name_key("client_name"))
    d = domains.select(F.col("key").alias("_dk"), F.col("correct").alias("_dc"))
    c = c.join(d, F.col("_k") == F.col("_dk"), "left")
    moved = F.col("_dc").isNotNull() & ~F.col("_dc").eqNullSafe(F.col("client_domain"))
    was = F.coalesce(blank_to_null(F.col("client_domain")), F.lit("blank"))
    c = c.withColumn("_moved", moved).withColumn(
        "source", F.when(moved, F.concat("source", F.lit(" | domain corrected from '"), was, F.lit("' (your correction)"))).otherwise(F.col("source"))
    )
    c = c.withColumn("client_domain", F.coalesce("_dc", "client_domain")).drop("_dk", "_dc", "_k")
    stem = F.substring_index(F.coalesce("client_domain", F.lit("")), ".", 1)
    keyed = stage(c.withColumn("_row", F.struct("agency", "seq")), "renamed")
    forms = keyed.select("_row", "agency", F.explode(F.array_union(match_forms("client_name"), match_forms(stem))).alias("form"))
    j = junk.select(F.col("form").alias("_form"), F.col("agency").alias("_agency"))
    bad = forms.join(j, forms["form"] == j["_form"]).filter("_agency IS NULL OR _agency = agency").select("_row").distinct()
    c = keyed.join(bad, "_row", "left_anti")
    lv = levels.select(F.col("method").alias("_m"), level_rank(F.col("level")).alias("_lr"))
    best = c.select("_row", F.explode("methods").alias("_m")).join(lv, "_m").groupBy("_row").agg(F.min("_lr").alias("_lr"))
    c = c.join(best, "_row", "left")
    fixed = F.col("_renamed") | F.col("_moved")
    return c.withColumn("rank", F.when(fixed, 0).otherwise(F.coalesce("_lr", "rank"))).drop("_row", "_lr", "_renamed", "_moved")


def final(clients: DataFrame) -> DataFrame:
    return clients.select("agency", "client_name", "client_domain", "source", _level(F.col("rank")).alias("confidence"), "seq")


def fold_pages(records: DataFrame) -> DataFrame:
    """The whole fold: merge, reconcile, promote, attach."""
    merged = stage(merge_records(records), "merged")
    return attach_domains(stage(promote(reconcile(merged)), "reconciled"))


def best_page(records: DataFrame) -> DataFrame:
    """Per agency the page with most clients, the earliest on ties; NULL when no page has any."""
    per = records.groupBy("agency", "page_url").agg(F.count("client_name").alias("n"), F.min("page_ord").alias("o"))
    return per.groupBy("agency").agg(F.max_by(F.when(F.col("n") > 0, F.col("page_url")), F.struct("n", -F.col("o"))).alias("page_url"))


def carry_names(tags: DataFrame, clients: DataFrame) -> DataFrame:
    """Scans with the names of the first client row of their site; a scan's own names win."""
    c = clients.select(root_domain("client_domain").alias("_site"), F.struct("client_name", "agency_name").alias("_n"), F.col("client_row").alias("_s"))
    c = c.filter("_site IS NOT NULL").groupBy("_site").agg(F.min_by("_n", "_s").alias("_n"))
    t = tags.withColumn("_root", root_domain("domain")).join(c, F.col("_root") == F.col("_site"), "left")
    for col in ("client_name", "agency_name"):
        t = t.withColumn(col, F.coalesce(blank_to_null(F.col(col)), F.col(f"_n.{col}")))
    return t.drop("_root", "_site", "_n")


def path_depth_top(pages: DataFrame, depth: Column, most: int = 12) -> DataFrame:
    """Per agency at most ``most`` pages, shallow ones first, in order of appearance."""
    w = Window.partitionBy("agency").orderBy(depth, "ord")
    return pages.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")
