"""Main-content extraction over the node table: a heuristic and a learned model.

Both work on counters that the parser folded up, so a page's text is read once. Scores
are column expressions; containers are found by grouping on (page, element).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.runtime import checkpointed, grown
from webloom.sources.dom import nodes

CANDIDATE_TAGS = (
    "article main section div p pre td ul ol table blockquote h1 h2 h3 form aside nav header footer"
).split()
REGION_TAGS = "article main section div ul ol table form aside".split()
TAG_WEIGHTS = {5.0: ("article", "div"), 3.0: ("pre", "blockquote"), -3.0: ("form", "aside"), -5.0: ("nav", "footer", "header")}
LEAST_WORDS = 50


def tag_weight(tag: Column) -> Column:
    out = F.lit(0.0)
    for weight, tags in TAG_WEIGHTS.items():
        out = F.when(tag.isin(*tags), weight).otherwise(out)
    return out


def class_weight() -> Column:
    """-25 for a negative name and 25 for a positive one; both may hold."""
    return F.when(F.col("positive"), 25.0).otherwise(0.0) - F.when(F.col("negative"), 25.0).otherwise(0.0)


def link_density() -> Column:
    """The share of an element's text that is inside links."""
    own = F.when(F.col("tag") == "a", F.col("text_len")).otherwise(F.col("link_len"))
    return F.when(F.col("text_len") > 0, own / F.col("text_len")).otherwise(0.0)


def heuristic_limits(scope: float) -> tuple[float, int, float]:
    """For a breadth from 0 to 1: the text below which unlikely elements go, that of a paragraph at least, and the siblings' share of the best score."""
    scope = min(max(scope, 0.0), 1.0)

    def at(strict: float, usual: float, wide: float) -> float:
        return strict + (usual - strict) * scope * 2 if scope <= 0.5 else usual + (wide - usual) * (scope - 0.5) * 2

    return at(50, 200, 500), round(at(50, 25, 10)), at(0.4, 0.2, 0.05)


def heuristic_scores(found: DataFrame, scope: float = 0.5) -> DataFrame:
    """page_id, nid, tag, parent, last_desc, class, score, density: containers scored by the paragraphs in them.

    Elements with negative names and little text are taken out first, with all they hold
    and what they add to the counters above them. A div without blocks is a paragraph.
    """
    strip, least, _ = heuristic_limits(scope)
    unlikely = F.col("negative") & ~F.col("positive") & (F.col("stripped_len") < strip) & ~F.col("tag").isin("html", "body", "article", "main") & ~F.col("skipped")
    order = Window.partitionBy("page_id").orderBy("nid")
    until, before = (order.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
    reach = F.when(unlikely, F.col("last_desc"))
    # Of nested ones only the outermost counts against the elements above.
    outer = unlikely & ~F.coalesce(F.max(reach).over(before) >= F.col("nid"), F.lit(False))
    rows = found.withColumns({"gone": F.coalesce(F.max(reach).over(until) >= F.col("nid"), F.lit(False)), "outer": outer})
    summed = lambda c: F.sum(F.when(F.col("outer"), F.col(c)).otherwise(0)).over(until)
    rows = rows.withColumns({"gone_text": summed("text_len"), "gone_link": summed("link_len")})
    # What goes inside an element went between it and its last descendant.
    ends = rows.select("page_id", F.col("nid").alias("last_desc"), F.col("gone_text").alias("end_text"), F.col("gone_link").alias("end_link"))
    kept = rows.filter("NOT skipped AND NOT gone").join(grown(ends), ["page_id", "last_desc"]).withColumns(
        {
            "text_len": F.col("text_len") - F.col("end_text") + F.col("gone_text"),
            "link_len": F.col("link_len") - F.col("end_link") + F.col("gone_link"),
            "tag": F.when((F.col("tag") == "div") & ~F.col("block_child"), "p").otherwise(F.col("tag")),
        }
    )
    scored = kept.filter(F.col("tag").isin("p", "pre", "td") & (F.col("stripped_len") >= least))
    points = 1 + F.col("commas") + F.least(F.floor(F.col("stripped_len") / 100), F.lit(3))
    parents = kept.select("page_id", F.col("nid").alias("parent"), F.col("parent").alias("grandparent"))
    shares = F.explode(
        F.array(F.struct(F.col("parent").alias("nid"), points.cast("double").alias("points")), F.struct(F.col("grandparent").alias("nid"), (points * 0.5).alias("points")))
    )
    sums = (
        scored.join(grown(parents), ["page_id", "parent"]).select("page_id", shares.alias("s")).select("page_id", "s.nid", "s.points")
        .filter("nid IS NOT NULL").groupBy("page_id", "nid").agg(F.sum("points").alias("points"))
    )
    base = class_weight() + tag_weight(F.col("tag"))
    return kept.join(grown(sums), ["page_id", "nid"]).select(
        "page_id", "nid", "tag", "parent", "last_desc", F.col("attrs")["class"].alias("class"), (base + F.col("points")).alias("score"), link_density().alias("density")
    )


def heuristic_regions(pages: DataFrame, found: DataFrame | None = None, scope: float = 0.5) -> DataFrame:
    """page_id, nid, tag, score, is_best: the best container of each page and the siblings that go with it.

    ``found`` are the nodes of pages, if they are there already; ``scope`` is the breadth.
    """
    found = checkpointed(nodes(pages)) if found is None else found
    scores = heuristic_scores(found, scope).withColumn("adjusted", F.col("score") * (1 - F.col("density")))
    rank = Window.partitionBy("page_id").orderBy(F.desc("adjusted"), "nid")
    best = scores.withColumn("n", F.row_number().over(rank)).filter("n = 1").select(
        "page_id", F.col("nid").alias("best"), F.col("parent").alias("of"), F.col("adjusted").alias("best_score"), F.col("class").alias("best_class")
    )
    around = found.filter("NOT skipped").join(grown(best), "page_id").filter((F.col("nid") == F.col("best")) | (F.col("parent") == F.col("of")))
    around = around.join(grown(scores.select("page_id", "nid", "score")), ["page_id", "nid"], "left")
    same = (F.coalesce(F.col("attrs")["class"], F.lit("")) != "") & (F.col("attrs")["class"] == F.col("best_class"))
    raised = (F.coalesce("score", F.lit(0.0)) + F.when(same, F.col("best_score") * 0.2).otherwise(0.0)) * (1 - link_density())
    is_best = F.col("nid") == F.col("best")
    good = raised >= F.greatest(F.lit(10.0), F.col("best_score") * heuristic_limits(scope)[2])
    text = (F.col("tag") == "p") & (F.col("stripped_len") > 80) & (link_density() < 0.25)
    return around.filter(is_best | good | text).select(
        "page_id", "nid", "tag", F.when(is_best, F.col("best_score")).otherwise(raised).alias("score"), is_best.alias("is_best")
    )


def content_features(found: DataFrame) -> DataFrame:
    """The features of the learned model for every candidate element, with page_id, nid, parent, last_desc, tag."""
    live = found.filter("NOT skipped")
    children = live.filter("parent IS NOT NULL")
    signature = F.concat_ws("|", "tag", F.array_join(F.array_sort(F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != "")), " "))

    def repeats(key: Column, name: str) -> DataFrame:
        """The share of an element's children that have the most common key."""
        counts = children.groupBy("page_id", "parent", key.alias("key")).agg(F.count("*").alias("n"))
        return counts.groupBy("page_id", F.col("parent").alias("nid")).agg((F.max("n") / F.sum("n")).alias(name))

    cls = F.coalesce(F.col("attrs")["class"], F.lit(""))
    density = F.col("stripped_len") / F.greatest(F.col("n_desc"), F.lit(1))
    is_candidate = F.col("tag").isin(*CANDIDATE_TAGS)
    family, kin = Window.partitionBy("page_id", "parent"), Window.partitionBy("page_id", "parent", "tag")
    namesakes = Window.partitionBy("page_id", "parent", "cls")
    order = Window.partitionBy("page_id").orderBy("nid")
    own = F.when(is_candidate, density)
    rows = live.withColumns({"cls": cls, "density": density, "candidate": is_candidate}).withColumns(
        {
            "siblings": F.count("*").over(family) - 1,
            "same_tag": F.count("*").over(kin) - 1,
            "same_class": F.when(F.col("cls") != "", F.count("*").over(namesakes) - 1).otherwise(0),
            "around": F.sum(own).over(family) - F.coalesce(own, F.lit(0.0)),
            "around_n": F.count(own).over(family) - F.col("candidate").cast("int"),
        }
    )
    rows = rows.filter("candidate").withColumns({"index": F.row_number().over(order) - 1, "total": F.count("*").over(Window.partitionBy("page_id"))})
    rows = rows.join(grown(repeats(F.col("tag"), "tag_repeats")), ["page_id", "nid"], "left").join(grown(repeats(signature, "repeats")), ["page_id", "nid"], "left")
    flag = lambda c: c.cast("double")
    per = lambda c: F.col(c) / F.greatest(F.col("n_desc"), F.lit(1))
    tag, text_len = F.col("tag"), F.col("stripped_len")
    sibling_count = F.greatest(F.col("siblings"), F.lit(1))
    has_parent = F.col("parent").isNotNull()
    features = {
        "log_text_length": F.log1p(text_len),
        "log_text_density": F.log1p("density"),
        "log_descendant_count": F.log1p("n_desc"),
        "link_density": link_density(),
        "non_link_text_ratio": 1 - link_density(),
        "class_weight": class_weight() / 25,
        "tag_weight": tag_weight(tag) / 5,
        "depth": F.col("depth") / 10,
        "position_centrality": F.when(F.col("total") <= 1, 1.0).otherwise(1 - F.abs(F.col("index") / (F.col("total") - 1) - 0.5) * 2),
        "sibling_log_text_density": F.log1p(F.when(has_parent & (F.col("around_n") > 0), F.col("around") / F.col("around_n")).otherwise(0.0)),
        "same_tag_sibling_ratio": F.when(has_parent, F.col("same_tag") / sibling_count).otherwise(0.0),
        "same_class_sibling_ratio": F.when(has_parent, F.col("same_class") / sibling_count).otherwise(0.0),
        "sentence_score": F.least(F.col("sentences"), F.lit(12)) / 12,
        "comma_density": F.least(F.col("commas"), F.lit(12)) / F.greatest(text_len, F.lit(1)),
        "has_block_children": flag(F.col("block_child")),
        "paragraph_score_density": F.col("paragraph_score") / F.greatest(text_len, F.lit(1)),
        "anchor_count_ratio": per("n_a"),
        "interactive_ratio": per("n_interactive"),
        "heading_ratio": per("n_heading"),
        "paragraph_ratio": per("n_para"),
        "list_item_ratio": per("n_li"),
        "repeated_child_tag_ratio": F.coalesce("tag_repeats", F.lit(0.0)),
        "repeated_child_signature_ratio": F.coalesce("repeats", F.lit(0.0)),
        "positive_class": flag(F.col("positive")),
        "negative_class": flag(F.col("negative")),
        "ancestor_positive_bias": flag(F.col("above_positive")),
        "ancestor_negative_bias": flag(F.col("above_negative")),
        "is_article_like": flag(tag.isin("article", "main", "section")),
        "is_paragraph_like": flag(tag.isin("p", "pre", "blockquote", "td", "h1", "h2", "h3")),
        "is_list_like": flag(tag.isin("ul", "ol", "table")),
        "is_boilerplate_tag": flag(tag.isin("nav", "aside", "header", "footer")),
        "is_form_tag": flag(tag == "form"),
        "under_content_landmark": flag(F.col("under_content")),
        "under_boilerplate_landmark": flag(F.col("under_boilerplate")),
        "has_repeated_children": flag(F.coalesce("repeats", F.lit(0.0)) >= 0.5),
    }
    kept = ["page_id", "nid", "parent", "last_desc", "tag", "stripped_len", "text_len", "link_len"]
    return rows.select(*kept, *[c.alias(f"f_{k}") for k, c in features.items()])


def content_probability() -> Column:
    """The learned model's probability, as one generated expression over the feature columns."""
    z = F.lit(fixed.CONTENT_BIAS)
    for name, (weight, mean, scale) in fixed.CONTENT_MODEL.items():
        z = z + (F.col(f"f_{name}") - mean) / scale * weight
    return 1 / (1 + F.exp(-z))


def hand_probability() -> Column:
    """The probability by hand-set weights, over the feature columns."""
    z = F.lit(fixed.HAND_BIAS)
    for name, weight in fixed.HAND_WEIGHTS.items():
        z = z + F.col(f"f_{name}") * weight
    return 1 / (1 + F.exp(-z))


def node_threshold(scope: float) -> float:
    return max(0.30, min(0.72 - 0.42 * scope, 0.72))


def refinement_ratio(scope: float) -> float:
    return max(0.60, 0.82 - 0.22 * scope)


def sibling_ratio(scope: float) -> float:
    return max(0.05, 0.42 - 0.44 * scope)


def scored_features(found: DataFrame) -> DataFrame:
    """page_id, nid, parent, stripped_len, p: every candidate element that is strong enough for some breadth."""
    scored = content_features(found).withColumn("p", content_probability())
    return scored.filter(F.col("p") >= node_threshold(1.0)).select("page_id", "nid", "parent", "stripped_len", "p")


def learned_regions(pages: DataFrame, scope: float = 0.5, found: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """page_id, nid, tag, score, role: the content regions of each page for a breadth from 0 to 1.

    Strong elements vote for their parent and, by half, grandparent; from the best
    region the search goes down while a region inside is nearly as strong. A narrow
    scope keeps that core, a middle one adds up to two siblings, a wide one takes the
    parent. A page without regions gives its body if that has text. At most one row a
    region and three a page; the regions of a page are few and met in one array. ``found`` are
    the nodes of pages and ``scored`` their ``scored_features``, if they are there already.
    """
    scope = min(max(scope, 0.0), 1.0)
    found = checkpointed(nodes(pages)) if found is None else found
    scored = (scored_features(found) if scored is None else scored).filter(F.col("p") >= node_threshold(scope))
    vote = F.col("p") * F.log1p("stripped_len")
    parents = found.select("page_id", F.col("nid").alias("parent"), F.col("parent").alias("grandparent"))
    votes = scored.join(grown(parents), ["page_id", "parent"]).select(
        "page_id",
        F.explode(F.array(F.struct(F.col("parent").alias("nid"), vote.alias("vote")), F.struct(F.col("grandparent").alias("nid"), (vote * 0.5).alias("vote")))).alias("v"),
    ).select("page_id", "v.*").filter("nid IS NOT NULL").groupBy("page_id", "nid").agg(F.sum("vote").alias("vote"))
    regions = votes.join(grown(found), ["page_id", "nid"]).filter(F.col("tag").isin(*REGION_TAGS) & (F.col("stripped_len") >= 40))
    one = F.struct((-F.col("vote") * (1 - link_density())).alias("cost"), "nid", "last_desc", F.coalesce("parent", F.lit(-1)).alias("parent"), "tag")
    each = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("regions"))

    def deeper(core: Column, _: Column) -> Column:
        inside = F.filter("regions", lambda r: (r["nid"] > core["nid"]) & (r["nid"] <= core["last_desc"]))
        best = F.try_element_at(inside, F.lit(1))
        return F.when(F.coalesce(-best["cost"] >= -core["cost"] * refinement_ratio(scope), F.lit(False)), best).otherwise(core)

    core = F.aggregate("regions", F.col("regions")[0], deeper)
    cored = each.withColumn("core", core)
    peers = F.slice(
        F.filter(
            "regions",
            lambda r: (r["parent"] == F.col("core.parent")) & (r["nid"] != F.col("core.nid")) & (-r["cost"] >= -F.col("core.cost") * sibling_ratio(scope)),
        ),
        1,
        2,
    )
    chosen = F.array("core") if scope <= 0.05 or scope >= 0.95 else F.concat(F.array("core"), peers)
    rows = cored.select("page_id", "core.nid", F.explode(chosen).alias("r")).select(
        "page_id", "r.nid", "r.parent", "r.tag", (-F.col("r.cost")).alias("score"), F.when(F.col("r.nid") == F.col("nid"), "core").otherwise("peer").alias("role")
    )
    if scope >= 0.95:
        above = found.select("page_id", F.col("nid").alias("parent"), F.col("tag").alias("parent_tag"))
        wide = rows.join(grown(above), ["page_id", "parent"], "left").withColumn("up", F.coalesce(F.col("parent_tag") != "body", F.lit(False)))
        rows = wide.select(
            "page_id", F.when(F.col("up"), F.col("parent")).otherwise(F.col("nid")).alias("nid"), "parent",
            F.when(F.col("up"), F.col("parent_tag")).otherwise(F.col("tag")).alias("tag"), "score", "role",
        )
    bodies = found.filter("tag = 'body' AND stripped_len > 50").join(grown(rows.select("page_id").distinct()), "page_id", "left_anti")
    return rows.drop("parent").unionByName(bodies.select("page_id", "nid", "tag", F.lit(0.0).alias("score"), F.lit("body").alias("role")))


def semantic_container(pages: DataFrame, least: int = LEAST_WORDS, found: DataFrame | None = None) -> DataFrame:
    """page_id, nid, tag, words: main, else role=main, else the parent of several articles, else the only one.

    ``found`` are the nodes of pages, if they are there already.
    """
    found = (nodes(pages) if found is None else found).filter("NOT skipped")
    n_articles = F.count_if(F.col("tag") == "article").over(Window.partitionBy("page_id"))
    first_article = F.min(F.when(F.col("tag") == "article", F.struct("nid", "parent"))).over(Window.partitionBy("page_id"))
    rows = found.withColumns({"n_articles": n_articles, "first": first_article})
    rank = (
        F.when(F.col("tag") == "main", 1)
        .when(F.col("attrs")["role"] == "main", 2)
        .when((F.col("n_articles") > 1) & (F.col("nid") == F.col("first.parent")), 3)
        .when((F.col("n_articles") == 1) & (F.col("tag") == "article"), 4)
    )
    order = Window.partitionBy("page_id").orderBy("rank", "nid")
    ranked = rows.withColumn("rank", rank).filter((F.col("rank").isNotNull()) & (F.col("words") >= least))
    return ranked.withColumn("n", F.row_number().over(order)).filter("n = 1").select("page_id", "nid", "tag", "words")
