"""The corpus line: signals, tiers, sections, candidate addresses, fetching and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import looks_like_image, metric_direction, non_null, strip
from tessera.operators.documents import first_by_key
from tessera.sources.snapshots import Corpus

# Thresholds of the tiers, weights, peer-reviewed kinds of venue.
SILVER = {"citedness": 5.0, "h_index": 150, "fwci": 1.5}
GOLDEN = {"citedness": 9.0, "fwci": 4.0, "institution_h_index": 400}
WEIGHTS = {"bronze": 1.0, "silver": 2.0, "golden": 4.0}
PEER_REVIEWED = ("journal", "conference", "book series")

WORK = (
    "id string, doi string, title string, display_name string, publication_year int, cited_by_count int, fwci double,"
    " citation_normalized_percentile struct<value: double, is_in_top_1_percent: boolean, is_in_top_10_percent: boolean>,"
    " primary_location struct<source: struct<id: string, display_name: string, type: string>>, best_oa_location struct<pdf_url: string>,"
    " open_access struct<is_oa: boolean>, authorships array<struct<institutions: array<struct<id: string, display_name: string>>>>,"
    " locations array<struct<pdf_url: string, source: struct<type: string>>>, ids struct<pmcid: string>"
)


def at_least(value: Column, floor: float) -> Column:
    """Not null and no less than the floor."""
    return F.coalesce(value >= floor, F.lit(False))


def signals(works: DataFrame) -> DataFrame:
    """Flat signals of nested works; the lead is the first author with an institution."""
    tail = lambda c: F.coalesce(F.substring_index(c, "/", -1), F.lit(""))
    lead = F.try_element_at(F.filter("authorships", lambda a: F.size(F.coalesce(a["institutions"], F.array().cast("array<struct<id: string, display_name: string>>"))) > 0), F.lit(1))["institutions"]
    lead = F.try_element_at(lead, F.lit(1))
    text = lambda *c: F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in c], F.lit(""))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return works.select(
        tail(F.col("id")).alias("work_id"), F.replace(F.coalesce("doi", F.lit("")), F.lit("https://doi.org/"), F.lit("")).alias("doi"), text("title", "display_name").alias("title"),
        F.col("publication_year").alias("year"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), "fwci", F.col("citation_normalized_percentile.value").alias("top_percentile"),
        yes("citation_normalized_percentile.is_in_top_1_percent").alias("top1"), yes("citation_normalized_percentile.is_in_top_10_percent").alias("top10"),
        text("primary_location.source.display_name").alias("venue"), text("primary_location.source.type").alias("venue_type"), tail(F.col("primary_location.source.id")).alias("source_id"),
        F.coalesce(lead["display_name"], F.lit("")).alias("lead_institution"), tail(lead["id"]).alias("institution_id"), yes("open_access.is_oa").alias("is_oa"), text("best_oa_location.pdf_url").alias("pdf_url"),
    )


def enriched(rows: DataFrame, venues: DataFrame, institutions: DataFrame) -> DataFrame:
    """Venue and institution metrics by id; a miss leaves nulls.  Metrics are joined once per distinct id."""
    v = venues.select(F.col("id").alias("source_id"), F.col("two_year_citedness").alias("citedness"), F.col("h_index"))
    i = institutions.select(F.col("id").alias("institution_id"), F.col("h_index").alias("institution_h_index"))
    return rows.join(v, "source_id", "left").join(i, "institution_id", "left")


def tiered(rows: DataFrame) -> DataFrame:
    """Adds tier, weight and ordered reasons; golden implies silver."""
    peer = F.coalesce(F.col("venue_type").isin(*PEER_REVIEWED), F.lit(False))
    cited, venue_h = at_least(F.col("citedness"), SILVER["citedness"]), at_least(F.col("h_index"), SILVER["h_index"])
    silver = (peer & (cited | venue_h)) | at_least(F.col("fwci"), SILVER["fwci"]) | F.col("top10")
    lead = at_least(F.col("institution_h_index"), GOLDEN["institution_h_index"])
    golden = silver & peer & at_least(F.col("citedness"), GOLDEN["citedness"]) & (at_least(F.col("fwci"), GOLDEN["fwci"]) | F.col("top1") | lead)
    tier = F.when(golden, "golden").when(silver, "silver").otherwise("bronze")
    one = lambda c: F.format_string("%.1f", F.col(c))
    reasons = non_null(
        F.when(silver & F.col("top10"), "top-10% in field+year"),
        F.when(silver & at_least(F.col("fwci"), SILVER["fwci"]), F.concat(F.lit("fwci="), one("fwci"))),
        F.when(silver & peer & cited, F.concat(F.lit("venue 2yr-citedness="), one("citedness"))).when(silver & peer & venue_h, F.concat(F.lit("venue h-index="), F.col("h_index").cast("string"))),
        F.when(golden & F.col("top1"), "top-1% in field+year"),
        F.when(golden & at_least(F.col("fwci"), GOLDEN["fwci"]), F.concat(F.lit("fwci="), one("fwci"), F.lit(" (field-leading)"))),
        F.when(golden & lead, F.concat(F.lit("prominent group ("), "lead_institution", F.lit(", h="), F.col("institution_h_index").cast("string"), F.lit(")"))),
    )
    weight = F.when(tier == "golden", WEIGHTS["golden"]).when(tier == "silver", WEIGHTS["silver"]).otherwise(WEIGHTS["bronze"])
    return rows.withColumns({"tier": tier, "weight": weight, "reasons": reasons})


def first_topic(manifests: DataFrame) -> DataFrame:
    """Of a work that several topics found, the row of the first topic, then rank."""
    return first_by_key(manifests, ["work_id"], ["topic_ord", "rank"])


def tier_shares(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by tier, with each tier's share of its group in percent."""
    counts = rows.groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def candidate_urls(works: DataFrame) -> DataFrame:
    """Ordered addresses without repeats: a rendered copy first, the manifest's, repositories', others', providers'.

    Columns: work_id, manifest_url, pmcid, locations, and arrays semantic, core, unpaywall; absent ones are empty.
    """
    good = lambda a: F.filter(a, lambda u: u.isNotNull() & (u != "") & ~looks_like_image(u))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    places = F.coalesce("locations", F.array().cast("array<struct<pdf_url: string, source: struct<type: string>>>"))
    repository = lambda x: F.coalesce(x["source"]["type"] == "repository", F.lit(False))
    urls = lambda a: F.transform(a, lambda x: x["pdf_url"])
    found = good(F.concat(F.array("manifest_url"), urls(F.filter(places, repository)), urls(F.filter(places, lambda x: ~repository(x))), some("semantic"), some("core"), some("unpaywall")))
    texts = F.concat(F.array(F.coalesce("pmcid", F.lit("")), F.coalesce("manifest_url", F.lit(""))), found)
    pmc = F.try_element_at(F.filter(F.transform(texts, lambda t: F.regexp_extract(t, r"(?i)PMC(\d+)", 1)), lambda t: t != ""), F.lit(1))
    first = F.when(pmc.isNotNull(), F.array(F.concat(F.lit("https://europepmc.org/articles/PMC"), pmc, F.lit("?pdf=render")))).otherwise(F.array().cast("array<string>"))
    return works.select("work_id", F.array_distinct(F.concat(first, found)).alias("urls"))


def fetch_reason(allowed: Column, tier_ok: Column, present_bytes: Column, is_oa: Column) -> Column:
    """Why a work isn't fetched, the first that holds; null if it is."""
    return F.when(~allowed, "not in id list").when(~tier_ok, "tier").when(F.coalesce(present_bytes > 1000, F.lit(False)), "already present").when(~F.coalesce(is_oa, F.lit(False)), "not open access")


def pdf_ok(content: Column, most: int = 80_000_000) -> Column:
    """A PDF's first bytes and a size within the cap."""
    return (F.substring(content, 1, 4) == F.unhex(F.lit("25504446"))) & (F.octet_length(content) <= most)


# Block types that carry no narrative, and headers' buckets in order.
DROPPED_BLOCKS = ("footer", "page_number", "ref_text", "aside_text", "page_footer", "page_header")
BUCKETS = [("abstract", r"(?i)\babstract\b"), ("introduction", r"(?i)\bintroduction\b|^1\.?\s"), ("methods", r"(?i)\b(method|computational|experimental|theory|theoretical|model)"), ("results", r"(?i)\b(result|discussion)"), ("conclusion", r"(?i)\b(conclusion|summary|outlook)")]
CAPS = [("abstract", 1800), ("introduction", 5000), ("methods", 3500), ("results", 6000), ("conclusion", 2500)]


def bucket(header: Column) -> Column:
    """the first bucket whose pattern a header matches, else the header itself, cut to 40."""
    return F.coalesce(*(F.when(header.rlike(p), b) for b, p in BUCKETS), F.left(header, F.lit(40)))


def headed(blocks: DataFrame) -> DataFrame:
    """Rows (paper_id, pos, type, text, text_level) without dropped types, with ``header``: null for what isn't a heading.

    Headings have level 1 or 2; parsers differ in which of them is the title.
    """
    kept = blocks.where(~F.coalesce(F.col("type").isin(*DROPPED_BLOCKS), F.lit(False)))
    is_header = F.coalesce(F.col("text_level").isin(1, 2), F.lit(False)) & F.col("type").isin("header", "text")
    return kept.withColumn("header", F.when(is_header, strip(F.coalesce("text", F.lit("")))))


def paper_titles(blocks: DataFrame) -> DataFrame:
    """The first substantive heading: over 12 characters and no note on citing."""
    good = (F.length("header") > 12) & ~F.contains(F.lower("header"), F.lit("cite"))
    d = headed(blocks).groupBy("paper_id").agg(F.min_by("header", F.when(good, F.col("pos"))).alias("title"))
    return d.select("paper_id", F.coalesce("title", F.lit("(untitled)")).alias("title"))


def paper_sections(blocks: DataFrame) -> DataFrame:
    """One text for each bucket of a paper; what stands before any heading is _pre."""
    order = Window.partitionBy("paper_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = headed(blocks).withColumn("section", F.coalesce(F.last(bucket(F.col("header")), ignorenulls=True).over(order), F.lit("_pre")))
    text = strip(F.coalesce("text", F.lit("")))
    rows = filled.where(F.col("header").isNull() & F.col("type").isin("text", "list", "equation")).withColumn("text", text).where("text != ''")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return rows.groupBy("paper_id", "section").agg(F.min("pos").alias("first"), F.array_join(texts, " ").alias("text"))


def narrative(sections: DataFrame, titles: DataFrame) -> DataFrame:
    """the capped buckets in reading order; all text outside the title's own section where they give under 600 characters."""
    d = sections.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("first", "section", "text"))).alias("parts")).join(titles, "paper_id", "left")
    d = d.withColumn("m", F.map_from_entries(F.transform("parts", lambda p: F.struct(p["section"].alias("k"), p["text"].alias("v")))))
    part = lambda b, cap: F.concat(F.lit(f"## {b.upper()}\n"), F.left(F.try_element_at("m", F.lit(b)), F.lit(cap)))
    told = F.concat_ws("\n\n", *(part(b, cap) for b, cap in CAPS))
    own = F.left("title", F.lit(40))
    rest = F.array_join(F.transform(F.filter("parts", lambda p: (p["section"] != "_pre") & (p["section"] != own)), lambda p: p["text"]), " ")
    return d.select("paper_id", F.when((F.length(told) < 600) & (F.length(rest) > F.length(told)), F.concat(F.lit("## BODY\n"), F.left(rest, F.lit(16000)))).otherwise(told).alias("narrative"))


ADSORPTION_HANDLES = ("co_adsorption_energy", "site_preference", "coverage_shift")


def task_rows(patterns: DataFrame, claims: DataFrame, golds: DataFrame) -> DataFrame:
    """One task a pattern: its handle with a numeric gold if there is one, and what is asked for.

    ``claims`` are parsed records (task, pos, handle, numeric); ``golds`` one a (task, handle).
    """
    best = claims.groupBy("task").agg(F.min_by("handle", F.struct(F.col("numeric").isNull(), "pos")).alias("handle"))
    d = patterns.join(best, patterns["paper_id"] == best["task"], "left").drop("task").withColumn("handle", F.coalesce("handle", F.lit("")))
    g = golds.select(F.col("task").alias("paper_id"), "handle", F.col("numeric").alias("sota"))
    d = d.join(g, ["paper_id", "handle"], "left")
    ready = (F.col("handle") != "") & (F.col("handle").isin(*ADSORPTION_HANDLES) | F.contains(F.lower("handle"), F.lit("adsorption")))
    higher = F.when(F.col("handle") != "", metric_direction(F.col("handle")))
    objective = F.when(F.col("sota").isNull(), "reach_conclusion").when(higher.isNotNull(), "reproduce_or_surpass").otherwise("reproduce")
    return d.withColumns({"qe_ready": ready, "unverified": ~ready, "higher_is_better": higher, "objective": objective})


def gold_block(value_raw: Column, claim: Column, energy: Column, numeric: Column, unit: Column, handle: Column) -> Column:
    """Value and unit only together; the first site named, for tasks about sites."""
    value = F.coalesce(energy, numeric)
    said = F.lower(F.coalesce(F.when(value_raw != "", value_raw), claim, F.lit("")))
    site = F.coalesce(*(F.when(F.contains(said, F.lit(s)), r) for s, r in (("atop", "ontop"), ("ontop", "ontop"), ("fcc", "fcc"), ("hcp", "hcp"), ("bridge", "bridge"), ("hollow", "fcc"), ("top", "ontop"))))
    both = value.isNotNull() & (F.coalesce(unit, F.lit("")) != "")
    return F.struct(F.coalesce(claim, F.lit("")).alias("claim"), F.when(both, value).alias("value"), F.when(both, unit).alias("unit"), F.when(handle == "site_preference", site).alias("site_preference"))


def lookup_key(stem: Column) -> Column:
    """What a pattern's file name stands for: a work's id, or a DOI with its first underscore as the slash."""
    cut = F.instr(stem, "_")
    return F.when(stem.rlike(r"^W\d+\z") | (cut == 0), stem).otherwise(F.concat(F.left(stem, cut - 1), F.lit("/"), F.substr(stem, cut + 1)))


def backfill_tiers(patterns: Corpus, sidecar: Corpus, resolved: DataFrame) -> None:
    """Tiers of works, kept in a sidecar by key, put into stored patterns (stem, ...).

    ``resolved`` has key, tier, weight and reasons; its records replace the sidecar's.  A
    pattern that isn't resolved is bronze.  The sidecar is published first: if the second
    step breaks off, a run again ends alike, as both steps give the same for the same input.
    """
    known = sidecar.versions()
    if known:
        sidecar.change(lambda old: old.join(resolved.select("key"), "key", "left_anti").unionByName(resolved))
    else:
        sidecar.publish(resolved, 0)
    tiers = sidecar.read().select("key", F.col("tier").alias("_tier"), F.col("weight").alias("_weight"), F.col("reasons").alias("_reasons"))

    def augmented(rows: DataFrame) -> DataFrame:
        own = [c for c in rows.columns if c not in ("tier", "tier_weight", "tier_reasons")]
        found = rows.select(*own).withColumn("key", lookup_key(F.col("stem"))).join(tiers, "key", "left")
        return found.select(*own, F.coalesce("_tier", F.lit("bronze")).alias("tier"), F.coalesce("_weight", F.lit(1.0)).alias("tier_weight"), F.coalesce("_reasons", F.array(F.lit("not found"))).alias("tier_reasons"))

    patterns.change(augmented)


def labelled_union(sets: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Sets under their labels put together, and counted by label and columns; a row may be in several sets."""
    parts = [df.select(F.lit(name).alias("label"), *by) for name, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("label", *by).agg(F.count(F.lit(1)).alias("n"))
