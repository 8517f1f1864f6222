"""Term vectors, centroids, similarity search, clusters and association rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .extract import small


def term_counts(docs: DataFrame, id_col: str, text_col: str, longest: int = 1, stop: list[str] = (), chars: int = 0) -> DataFrame:
    """``(id, term, tf)`` of the runs of 1 to ``longest`` words, or of the runs of ``chars`` characters if given."""
    # the words (or the text) are a column of their own, or every run would read the text again
    letters = F.filter(F.split(F.regexp_replace(F.lower(F.col(text_col)), r"\s\s+", " "), ""), lambda x: x != "")
    words = letters if chars else tx.tokens(F.col(text_col), stop)
    src = docs.select(F.col(id_col).alias("id"), words.alias("w")).where("w is not null")
    terms = tx.char_grams(F.col("w"), chars) if chars else tx.ngrams(F.col("w"), longest)
    return src.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 1.0, most: int | None = None) -> DataFrame:
    """``(term, idf)``: terms of at least ``min_df`` documents and at most ``max_df`` of them, the ``most`` frequent ones (ties by term), with smooth idf ``ln((1 + n) / (1 + df)) + 1``."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if most is not None:
        df = df.orderBy(F.desc("all"), "term").limit(most)
    return df.select("term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(counts: DataFrame, vocab: DataFrame, sublinear: bool = False) -> DataFrame:
    """``(id, term, weight)`` of the terms in the vocabulary, each document of unit length."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = counts.join(small(vocab), "term").select("id", "term", (tf * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf(counts: DataFrame, n_docs: int, min_df: int = 2, sublinear: bool = False, max_df: float = 1.0, most: int | None = None) -> DataFrame:
    """``weigh`` by the ``vocabulary`` of the same documents."""
    return weigh(counts, vocabulary(counts, n_docs, min_df, max_df, most), sublinear)


def centroids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``(label, term, weight)``: mean vector of each label; absent terms count as zero."""
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    summed = vectors.join(labels, "id").groupBy("label", "term").agg(F.sum("weight").alias("s"))
    return summed.join(small(size), "label").select("label", "term", (F.col("s") / F.col("n")).alias("weight"))


def nearest_centroid(vectors: DataFrame, cents: DataFrame) -> DataFrame:
    """``(id, label, similarity)`` of the label with the highest cosine, ties by label.

    The centroids are one row a term with a list over its labels. Where they are small they are sent to all tasks, and as the vectors are laid out by document first,
    the products are summed where they are made; else both meet by term.
    """
    norm = cents.groupBy("label").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    unit = cents.join(small(norm), "label").groupBy("term").agg(F.collect_list(F.struct("label", (F.col("weight") / F.col("norm")).alias("cw"))).alias("cents"))
    rows = vectors.repartition("id").join(small(unit), "term").select("id", "weight", F.explode("cents").alias("c"))
    sims = rows.groupBy("id", "c.label").agg(F.sum(F.col("weight") * F.col("c.cw")).alias("similarity"))
    return sims.groupBy("id").agg(F.max_by(F.struct("label", "similarity"), F.struct(F.round("similarity", 9), _backwards("label"))).alias("best")).select("id", "best.*")


def _backwards(label: str) -> Column:
    """A key that falls as the label rises, by code point."""
    return F.concat(F.transform(F.split(F.col(label), ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))


def characteristic_terms(vectors: DataFrame, labels: DataFrame, k: int = 8, least_docs: int = 1, shape: str = "") -> DataFrame:
    """``(label, term, score, rank_no)``: terms whose mean weight inside a label most exceeds the mean outside, all labels in one pass.

    Labels of under ``least_docs`` documents have none; of the best ``3 * k`` terms those that match ``shape`` stay.
    """
    n = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs)
    all_n = labels.agg(F.count("*").alias("all_n"))
    inside = vectors.join(labels, "id").groupBy("label", "term").agg(F.sum("weight").alias("s_in"))
    whole = inside.groupBy("term").agg(F.sum("s_in").alias("s_all"))
    out = inside.join(whole, "term").join(small(n), "label").join(small(all_n))
    out = out.withColumn("score", F.round(F.col("s_in") / F.col("n") - (F.col("s_all") - F.col("s_in")) / F.greatest(F.col("all_n") - F.col("n"), F.lit(1)), 6))
    w = Window.partitionBy("label").orderBy(F.desc("score"), F.asc("term"))
    out = out.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= 3 * k).where(F.col("term").rlike(shape))
    return out.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k).select("label", "term", "score", "rank_no")


def term_lists(terms: DataFrame) -> DataFrame:
    """``(label, terms)``: the characteristic terms of each label, best first."""
    return terms.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank_no", "term"))).alias("t")).select("label", F.transform("t", lambda x: x["term"]).alias("terms"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def lexicon_search(phrases: DataFrame, phrase: str, lexicon: DataFrame, k: int = 3, least: float = 0.15) -> DataFrame:
    """``(phrase, canonical, score, rank_no)``: the ``k`` entries nearest each distinct phrase by TF-IDF cosine over runs of one to three words, at least ``least``.

    Only phrases and entries that share a term meet: the term vectors are joined, not the rows.
    """
    texts = lexicon.select("canonical", tx.embedding_text(F.col("canonical"), F.col("category"), F.col("description"), F.col("aliases")).alias("text"))
    n = texts.count()
    counts = term_counts(texts, "canonical", "text", 3)
    vocab = vocabulary(counts, n, 1)
    entry = weigh(counts, vocab).select(F.col("id").alias("canonical"), "term", F.col("weight").alias("ew"))
    p = phrases.select(F.col(phrase).alias("id")).distinct().withColumn("text", F.col("id"))
    raw = term_counts(p, "id", "text", 3).join(small(vocab), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sims = raw.join(small(entry), "term").groupBy("id", "canonical").agg(F.sum(F.col("w") * F.col("ew")).alias("dot")).join(norm, "id")
    sims = sims.select(F.col("id").alias("phrase"), "canonical", F.round(F.least(F.col("dot") / F.col("norm"), F.lit(1.0)), 6).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("phrase").orderBy(F.desc("score"), F.asc("canonical"))
    return sims.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


EXPERIENCE_NAMES = ["years", "years_capped_8", "role_count", "leadership", "impact", "quantified", "has_senior_experience"]
SKILL_NAMES = ["n_raw", "n_normalized", "avg_confidence", "max_confidence"]
STRUCTURE_NAMES = ["n_education", "n_experience", "n_certifications", "n_projects", "log_length"]


def feature_names(labels: list[str], categories: list[str]) -> list[str]:
    """Names of the places of ``feature_rows``."""
    named = [("fit", labels), ("top_profile", labels), ("exp", EXPERIENCE_NAMES), ("skills", SKILL_NAMES), ("skill_cat", categories), ("struct", STRUCTURE_NAMES)]
    return [f"{block}::{name}" for block, names in named for name in names]


def feature_rows(docs: DataFrame, scores: DataFrame, experience: DataFrame, skills: DataFrame, extracted: DataFrame, labels: list[str], categories: list[str]) -> DataFrame:
    """``(resume_id, features)`` of every row of ``docs`` (resume_id, log_length): fit per label out of 1, the first best label as one-hot, experience, skill, category and structure blocks.

    ``labels`` and ``categories`` are small fixed lists in order. Repeated rows of ``extracted`` count once, null and blank elements don't; what is missing is 0.
    """
    fit = scores.groupBy("resume_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("fit_score") / 100))).alias("fit"))
    live = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    lists = extracted.groupBy("resume_id").agg(*(F.max(live(F.col(c))).alias(f"n_{c}") for c in ("skills_raw", "education", "experience", "certifications", "projects")))
    by = skills.groupBy("resume_id", "category").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.max("confidence").alias("m"))
    own = by.groupBy("resume_id").agg(
        F.sum("n").alias("n_normalized"), (F.sum("s") / F.sum("n")).alias("avg_confidence"), F.max("m").alias("max_confidence"),
        F.sum(F.when(F.col("category").isNotNull(), F.col("n"))).alias("n_named"), F.map_from_entries(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "n")))).alias("by_category"),
    )
    rows = docs.join(fit, "resume_id", "left").join(experience, "resume_id", "left").join(own, "resume_id", "left").join(lists, "resume_id", "left")
    num = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0))
    rows = rows.withColumn("fits", F.array(*(num(F.col("fit")[label]) for label in labels)))
    top = F.array_position("fits", F.array_max("fits"))
    blocks = [
        F.col("fits"), F.array(*((top == k + 1).cast("double") for k in range(len(labels)))),
        F.array(num("total_years"), F.least(num("total_years"), F.lit(8.0)) / 8, num("role_count"), num("leadership_indicators"), num("impact_statements"), num("quantified_impact"), (num("total_years") >= 5).cast("double")),
        F.array(num("n_skills_raw"), num("n_normalized"), num("avg_confidence"), num("max_confidence")),
        F.array(*(num(F.col("by_category")[c] / F.col("n_named")) for c in categories)),
        F.array(num("n_education"), num("n_experience"), num("n_certifications"), num("n_projects"), num("log_length")),
    ]
    return rows.select("resume_id", F.concat(*blocks).alias("features"))


def cluster(rows: DataFrame, id_col: str, items_col: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """``(id, cluster)`` by k-means over item incidence; ``k`` defaults to the root of the row count between 2 and 4."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import CountVectorizer

    live = rows.where(F.size(items_col) > 0)
    n = live.count()
    if n < 2:
        return live.select(F.col(id_col).alias("id"), F.lit(0).alias("cluster"))
    # as many places as there are items: none is left out
    items = live.select(F.explode(items_col).alias("i")).agg(F.countDistinct("i")).first()[0]
    vec = CountVectorizer(inputCol=items_col, outputCol="features", binary=True, vocabSize=max(items, 1)).fit(live).transform(live)
    model = KMeans(k=min(n, k or max(2, min(4, int(n**0.5)))), seed=seed, maxIter=20).fit(vec)
    return model.transform(vec).select(F.col(id_col).alias("id"), F.col("prediction").alias("cluster"))


def cluster_summary(assigned: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """``(cluster, size, item, share, rank_no)``: the ``k`` most frequent items of each cluster."""
    size = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    share = assigned.join(items, "id").groupBy("cluster", "item").agg(F.countDistinct("id").alias("n")).join(small(size), "cluster").withColumn("share", F.col("n") / F.col("size"))
    w = Window.partitionBy("cluster").orderBy(F.desc("share"), F.asc("item"))
    return share.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k).select("cluster", "size", "item", "share", "rank_no")


def association_rules(baskets: DataFrame, items_col: str, min_support: float = 0.2, min_confidence: float = 0.6) -> DataFrame:
    """``(antecedents, consequents, support, confidence, lift)`` over all splits of each frequent itemset; empty baskets count.

    Itemsets come from the distributed FP-growth; each is joined with the supports of its parts.
    """
    from pyspark.ml.fpm import FPGrowth

    live = baskets.select(F.array_distinct(items_col).alias("items"))
    n = live.count()
    sets = FPGrowth(itemsCol="items", minSupport=min_support).fit(live).freqItemsets.select(F.sort_array("items").alias("items"), (F.col("freq") / n).alias("support"))
    # each itemset is split by every bit mask but the empty and the full one
    mask = F.explode(F.expr("sequence(1, shiftleft(1, size(items)) - 2)"))
    masked = sets.where(F.size("items") > 1).select("items", "support", mask.alias("mask"))
    side = lambda bit: F.filter("items", lambda x, i: F.call_function("getbit", F.col("mask"), i) == bit)
    splits = masked.select(side(1).alias("antecedents"), side(0).alias("consequents"), "support")
    a = sets.select(F.col("items").alias("antecedents"), F.col("support").alias("sa"))
    c = sets.select(F.col("items").alias("consequents"), F.col("support").alias("sc"))
    out = splits.join(a, "antecedents").join(c, "consequents").withColumn("confidence", F.col("support") / F.col("sa"))
    return out.where(F.col("confidence") >= min_confidence - 1e-12).select("antecedents", "consequents", "support", "confidence", (F.col("confidence") / F.col("sc")).alias("lift"))


def stratified_split(rows: DataFrame, id_col: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``rows`` with ``split_name`` 'train' or 'test': of all rows the whole number next above the share, dealt to the labels by largest remainder (ties by label), in the order of a hash of the id.

    Null labels are a label of their own. If a label has a single row, labels are not kept apart. A label's rows are ranked only in the bin of hashes in which its
    quota ends, so a label that holds a third of all rows is not sorted in one task.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col)))
    tagged = rows.withColumn("_label", F.coalesce(F.col(label).cast("string"), F.lit("\x00"))).withColumn("_key", key).withColumn("_bin", F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"))
    sizes = tagged.groupBy("_label").agg(F.count("*").alias("n"))
    if sizes.where("n = 1").limit(1).count():
        tagged = tagged.withColumn("_label", F.lit(""))
        sizes = tagged.groupBy("_label").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    whole = F.ceil(F.col("total") * test_share - 1e-9)
    share = sizes.join(small(total)).withColumn("exact", F.col("n") * whole / F.col("total")).withColumn("least", F.floor("exact"))
    spare = Window.orderBy(F.desc(F.round(F.col("exact") - F.col("least"), 9)), "_label")  # one row a label
    left = Window.partitionBy()
    quota = share.withColumn("rn", F.row_number().over(spare)).withColumn("quota", F.col("least") + (F.col("rn") <= whole - F.sum("least").over(left)).cast("int")).select("_label", "quota")
    upto = Window.partitionBy("_label").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 65,536 bins a label
    bins = tagged.groupBy("_label", "_bin").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(upto)).join(small(quota), "_label")
    last = bins.where(F.col("upto") >= F.col("quota")).groupBy("_label").agg(F.min("_bin").alias("_last"), (F.max("quota") - F.min(F.col("upto") - F.col("c"))).alias("_rest"))
    met = tagged.join(small(last), "_label")
    rank = F.row_number().over(Window.partitionBy("_label", "_bin").orderBy("_key", id_col))
    edge = met.where(F.col("_bin") == F.col("_last")).withColumn("split_name", F.when(rank <= F.col("_rest"), "test").otherwise("train"))
    rest = met.where(F.col("_bin") != F.col("_last")).withColumn("split_name", F.when(F.col("_bin") < F.col("_last"), "test").otherwise("train"))
    return rest.unionByName(edge).select(*rows.columns, "split_name")


def stratified_sample(rows: DataFrame, id_col: str, label: str, per_class: int = 4, most: int = 120, seed: int = 42) -> DataFrame:
    """Of each label the ``per_class`` first rows by a hash of the id, of these the ``most`` first by another hash."""
    key = lambda s: F.md5(F.concat_ws(":", F.lit(s), F.col(id_col)))
    w = Window.partitionBy(F.coalesce(F.col(label), F.lit("unknown"))).orderBy(key(str(seed)), F.col(id_col))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_class).drop("_rn").orderBy(key(f"{seed}-all"), F.col(id_col)).limit(most)


def named_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(name_a, name_b, cosine)`` of each asked pair of names over unit vectors ``(id, term, weight)``; null where a name has no vector."""
    known = vectors.select("id").distinct()
    a, b = vectors.select(F.col("id").alias("name_a"), "term", F.col("weight").alias("x")), vectors.select(F.col("id").alias("name_b"), "term", F.col("weight").alias("y"))
    asked = pairs.select("name_a", "name_b").distinct()
    dots = asked.join(a, "name_a").join(b, ["name_b", "term"]).groupBy("name_a", "name_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    there = asked.join(small(known.withColumnRenamed("id", "name_a")), "name_a").join(small(known.withColumnRenamed("id", "name_b")), "name_b").withColumn("both", F.lit(1))
    out = asked.join(there, ["name_a", "name_b"], "left").join(dots, ["name_a", "name_b"], "left")
    return out.select("name_a", "name_b", F.when(F.col("both") == 1, F.round(F.coalesce("dot", F.lit(0.0)), 6)).alias("cosine"))


# fixed values: the bounds of learned profiles, and how much lower they are for labels of few documents
def learned_profiles(skills: DataFrame, labels: DataFrame, required: float = 0.30, preferred: float = 0.10, most_required: int = 6, most_preferred: int = 8, sparse: int = 35) -> DataFrame:
    """``(label, required_skills, preferred_skills)`` from how many of a label's documents name each skill; small labels use lower bounds."""
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    cover = skills.join(labels, "id").groupBy("label", "skill").agg(F.countDistinct("id").alias("c")).join(small(size), "label").withColumn("coverage", F.col("c") / F.col("n"))
    few = F.col("n") < sparse
    req = F.when(few, F.greatest(F.lit(required - 0.10), F.lit(0.20))).otherwise(F.lit(required))
    pref = F.when(few, F.greatest(F.lit(preferred - 0.05), F.lit(0.05))).otherwise(F.lit(preferred))
    w = Window.partitionBy("label").orderBy(F.desc("coverage"), F.asc("skill"))
    ranked = cover.where(F.col("coverage") >= pref).withColumn("rn", F.row_number().over(w)).withColumn("is_req", (F.col("rn") <= most_required) & (F.col("coverage") >= req))
    ranked = ranked.withColumn("has_req", F.max("is_req").over(Window.partitionBy("label"))).withColumn("is_req", F.when(F.col("has_req"), F.col("is_req")).otherwise(F.col("rn") <= 3))
    ranked = ranked.withColumn("pn", F.sum(F.when(F.col("is_req"), 0).otherwise(1)).over(w)).where(F.col("is_req") | (F.col("pn") <= most_preferred))
    take = lambda yes: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_req") if yes else ~F.col("is_req"), F.struct("rn", "skill")))), lambda x: x["skill"])
    return ranked.groupBy("label").agg(take(True).alias("required_skills"), take(False).alias("preferred_skills"))


def resolve_profiles(labels: DataFrame, learned: DataFrame, curated: DataFrame) -> DataFrame:
    """``(label, origin, description, required_skills, preferred_skills)`` of every label as spelled: the learned profile of its key, else the curated one, else one made up from the label's words.

    A learned profile without a description has the made-up one.
    """
    fields = ("description", "required_skills", "preferred_skills")
    side = lambda df, s: df.select(tx.label_key(F.col("label")).alias("key"), *(F.col(c).alias(f"{s}_{c}") for c in fields), F.lit(True).alias(s))
    words = F.lower(F.translate("label", "_-", "  "))
    rows = labels.select("label", tx.label_key(F.col("label")).alias("key")).join(small(side(learned, "l")), "key", "left").join(small(side(curated, "c")), "key", "left")
    made = F.concat(F.lit("Role focused on "), words, F.lit("."))
    first = lambda c, other: F.coalesce(F.col(f"l_{c}"), F.col(f"c_{c}"), other).alias(c)
    description = F.when(F.col("l"), F.coalesce("l_description", made)).otherwise(F.coalesce("c_description", made))
    origin = F.when(F.col("l"), "learned").when(F.col("c"), "curated").otherwise("made up")
    return rows.select("label", origin.alias("origin"), description.alias("description"), first("required_skills", F.split(words, " ")), first("preferred_skills", F.array().cast("array<string>")))
