"""Annotation votes: lanes, majority, agreement, Fleiss' kappa, consensus.

Votes are kept long: ``(id, task, annotator, rnk, label, reason)``.  Wide
forms are produced at the edge with conditional aggregates over an explicit
annotator list, so schemas are stable and there is no extra pass.  Every
grouping is by ``id`` (at most one row per annotator per id), so no group can
grow with the data; per-scope reports aggregate partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.functions import text as tx

DEFAULT_ANNOTATORS = ("deepseek", "mistral", "qwen")
# Canonical spelling of labels that appear under two names.
LABEL_ALIASES = {"REPORTED": "REPORT"}


def canonical_label(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    out = col
    for k, v in LABEL_ALIASES.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def vote_summary(votes: DataFrame, annotators=DEFAULT_ANNOTATORS, id_col: str = "id",
                 raw: bool = False) -> DataFrame:
    """One row per id: per-annotator labels, vote counts and the lane.

    Lanes partition the ids: ``similar`` (every annotator gave a label, all
    alike), ``different`` (every annotator gave a label, not all alike) and
    ``incomplete`` (a vote or a label is missing, or an annotator voted twice).

    By default labels are compared after trimming and alias mapping (C21);
    ``raw=True`` compares the literal replies, as the source's production mode.
    """
    if not raw:
        votes = votes.withColumn("label", canonical_label(tx.strip_ws("label")))
    per = [F.max(F.when(F.col("annotator") == a, F.col("label"))).alias(a) for a in annotators]
    need = len(annotators)
    lane = (F.when((F.col("n_votes") != need) | (F.col("n_labels") != need), "incomplete")
             .when(F.col("label") == F.col("_hi"), "similar").otherwise("different"))
    return (votes.groupBy(id_col)
                 .agg(F.min("label").alias("label"), F.max("label").alias("_hi"),
                      F.count(F.lit(1)).alias("n_votes"), F.count("label").alias("n_labels"), *per)
                 .withColumn("lane", lane).withColumn("unanimous", F.col("lane") == "similar").drop("_hi"))


def unanimous_votes(votes: DataFrame, annotators=DEFAULT_ANNOTATORS, id_col: str = "id") -> DataFrame:
    """G1 'similar' lane: ids whose labels all agree, with that label."""
    s = vote_summary(votes, annotators, id_col)
    return s.where("lane = 'similar'").select(id_col, "label")


def disputed_votes(votes: DataFrame, annotators=DEFAULT_ANNOTATORS, id_col: str = "id") -> DataFrame:
    """G1 'different' lane: ids with more than one label, one column per annotator."""
    s = vote_summary(votes, annotators, id_col)
    return s.where("lane = 'different'").select(id_col, *annotators)


def incomplete_votes(votes: DataFrame, annotators=DEFAULT_ANNOTATORS, id_col: str = "id") -> DataFrame:
    """G1 error lane: ids that lack a vote or a label, one column per annotator."""
    s = vote_summary(votes, annotators, id_col)
    return s.where("lane = 'incomplete'").select(id_col, *annotators)


def majority_vote(votes: DataFrame, id_col: str = "id") -> DataFrame:
    """Most common label per id; ties go to the label of the best-ranked annotator."""
    counts = votes.groupBy(id_col, "label").agg(F.count(F.lit(1)).alias("_n"), F.min("rnk").alias("_r"))
    best = F.max_by(F.col("label"), F.struct(F.col("_n"), -F.col("_r")))
    return counts.groupBy(id_col).agg(best.alias("label"))


def agreement_matrix(votes: DataFrame, domain, id_col: str = "id") -> DataFrame:
    """Per id, how many annotators chose each label of the domain."""
    cols = [F.count_if(F.col("label") == d).cast("long").alias("n_" + d.lower().replace("-", "_"))
            for d in domain]
    return votes.groupBy(id_col).agg(*cols)


def fleiss_kappa(votes: DataFrame, scope=None, id_col: str = "id",
                 min_raters: int = 3) -> DataFrame:
    """Fleiss' kappa per scope (one row overall when ``scope`` is None; a list of
    scope columns/expressions computes all of them in one pass).

    P_i = (sum_j n_ij^2 - n) / (n (n - 1)),  P = mean(P_i),
    p_j = sum_i n_ij / (N n),  P_e = sum_j p_j^2,  kappa = (P - P_e) / (1 - P_e).
    kappa is null below ``min_raters`` raters (the source computes it only
    for more than two) and when P_e = 1.  Everything is double.
    """
    if scope is None:
        v = votes.select(F.lit("all").alias("scope"), id_col, "label")
    elif isinstance(scope, (list, tuple)):
        # several scopes in one pass: each vote is counted once per scope
        v = votes.select(F.explode(F.array(*[F.col(c) if isinstance(c, str) else c for c in scope])).alias("scope"),
                         id_col, "label")
    else:
        v = votes.select(F.col(scope).alias("scope"), id_col, "label")
    nij = v.groupBy("scope", id_col, "label").agg(F.count(F.lit(1)).alias("nij"))
    subj = nij.groupBy("scope", id_col).agg(F.sum(F.col("nij") * F.col("nij")).alias("s2"),
                                            F.sum("nij").alias("n"))
    dbl = lambda c: F.col(c).cast("double")
    p_i = (dbl("s2") - dbl("n")) / (dbl("n") * (dbl("n") - F.lit(1.0)))
    per_scope = subj.groupBy("scope").agg(
        F.avg(F.when(F.col("n") > 1, p_i)).alias("_p_avg"),
        F.count(F.lit(1)).cast("long").alias("n_subjects"),
        F.min("n").alias("_n_min"), F.max("n").cast("long").alias("n_raters"),
        (F.sum("s2") - F.sum("n")).alias("_agree"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("_pairs"))
    # Equal raters per subject (the usual case): P = sum(s2 - n) / sum(n (n - 1)), from
    # exact integer sums, so the result does not depend on summation order.
    p_bar = F.when(F.col("_n_min") == F.col("n_raters"), dbl("_agree") / dbl("_pairs")).otherwise(F.col("_p_avg"))
    cat = nij.groupBy("scope", "label").agg(F.sum("nij").alias("nj"))
    pe = cat.groupBy("scope").agg(F.sum(F.col("nj") * F.col("nj")).alias("_c2"), F.sum("nj").alias("_tot"))
    p_e = dbl("_c2") / (dbl("_tot") * dbl("_tot"))
    out = per_scope.join(pe, "scope").select("scope", "n_subjects", "n_raters", p_bar.alias("p_bar"),
                                             p_e.alias("p_e"))
    kappa = F.when((F.col("n_raters") >= min_raters) & (F.col("p_e") != 1.0),
                   (F.col("p_bar") - F.col("p_e")) / (F.lit(1.0) - F.col("p_e")))
    return out.select("scope", "n_subjects", "n_raters", kappa.cast("double").alias("kappa"))


def disagreement_report(votes: DataFrame, info: DataFrame, annotators=DEFAULT_ANNOTATORS,
                        id_col: str = "id") -> DataFrame:
    """Ids with more than one label, with text, category, each annotator's label
    (``<annotator>_label``) and empty ``note`` / ``final`` for the human reviewer."""
    d = disputed_votes(votes, annotators, id_col)
    d = d.select(id_col, *[F.col(a).alias(f"{a}_label") for a in annotators])
    return (info.select(id_col, "text", "category").join(d, id_col)
                .withColumn("note", F.lit("")).withColumn("final", F.lit("")))


def consensus_labels(votes: DataFrame, info: DataFrame, task: str, id_col: str = "id",
                     annotators=DEFAULT_ANNOTATORS) -> DataFrame:
    """Every id with its agreed label, or '' (undecided) when annotators differ or one is missing."""
    s = vote_summary(votes, annotators, id_col)
    lab = F.when(F.col("unanimous"), F.col("label")).otherwise(F.lit(""))
    return info.select(id_col, "text", "category").join(s.select(id_col, lab.alias(task)), id_col)


def disagreement_by_category(report: DataFrame, id_col: str = "id") -> DataFrame:
    """Disagreements per category, the category being the id prefix."""
    return (report.groupBy(tx.id_prefix(id_col).alias("category"))
                  .agg(F.count(F.lit(1)).cast("long").alias("n_different")))


def disagreement_share(report: DataFrame, population: DataFrame, id_col: str = "id",
                       sample_size: int | None = None) -> DataFrame:
    """Similar vs different, overall ('all') and per category.

    The denominator is the real number of reviewed ids per scope (or a fixed
    ``sample_size`` when given, as the source's plots assumed).
    """
    pop = population.select(id_col, tx.id_prefix(id_col).alias("category"))
    diff = report.select(id_col).withColumn("_d", F.lit(1))
    j = pop.join(diff, id_col, "left")
    per = (j.rollup("category")
            .agg(F.count(F.lit(1)).cast("long").alias("n_total"),
                 F.count("_d").cast("long").alias("n_different")))
    total = F.lit(sample_size).cast("long") if sample_size else F.col("n_total")
    return per.select(F.coalesce("category", F.lit("all")).alias("scope"),
                      total.alias("n_total"), "n_different",
                      (total - F.col("n_different")).cast("long").alias("n_similar"),
                      (F.col("n_different") / total.cast("double")).alias("share_different"))


def consensus_resolve(consensus: DataFrame, human: DataFrame, model: DataFrame, task: str,
                      id_col: str = "id", policy: str = "human_first") -> DataFrame:
    """Fill undecided ('') labels.

    ``human_first`` (default): the human ``final`` when set, else the model label.
    ``reference``: the literal source rule - the model label when a human
    decision exists, else the (empty or missing) human decision.
    """
    # one row per id: of several decisions the greatest counts
    h = human.groupBy(id_col).agg(F.max("final").alias("_final"))
    m = model.groupBy(id_col).agg(F.max("label").alias("_model"))
    j = consensus.join(h, id_col, "left").join(m, id_col, "left")
    undecided = F.col(task) == ""
    if policy == "human_first":
        fill = F.coalesce(F.nullif(F.col("_final"), F.lit("")), F.col("_model"))
    elif policy == "reference":
        fill = F.when(F.coalesce(F.col("_final"), F.lit("")) != "", F.col("_model")).otherwise(F.col("_final"))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return j.withColumn(task, F.when(undecided, fill).otherwise(F.col(task))).drop("_final", "_model")


def vote_completeness(votes: DataFrame, annotators=DEFAULT_ANNOTATORS, id_col: str = "id") -> DataFrame:
    """Ids that some annotator did not label, with the missing names (in order).

    ``collect_set`` per id holds at most ``len(annotators)`` names.
    """
    expected = F.array(*[F.lit(a) for a in annotators])
    per = votes.groupBy(id_col).agg(F.collect_set("annotator").alias("_have"))
    missing = F.filter(expected, lambda a: ~F.array_contains(F.col("_have"), a))
    return (per.select(id_col, F.size("_have").cast("long").alias("n_annotators"), missing.alias("_m"))
               .where(F.size("_m") > 0)
               .select(id_col, "n_annotators", F.array_join("_m", ",").alias("missing")))


def label_domain_violations(df: DataFrame, label_col: str, domain, id_col: str = "id",
                            who: str = "annotator", strict: bool = False) -> DataFrame:
    """rows whose (canonicalised) label is outside the domain.

    With ``strict`` the query fails at run time on the first violation
    (``raise_error``), like the source's ValueError, without a driver collect.
    """
    lab = canonical_label(label_col)
    bad = df.where(lab.isNull() | ~lab.isin(*domain))
    out = bad.select(F.col(who), F.col(id_col), F.col(label_col).alias("label"))
    if strict:
        # in a filter, which no later projection or count can prune
        msg = F.concat(F.lit("invalid label "), F.coalesce(F.col("label"), F.lit("null")),
                       F.lit(" at ("), F.col(who), F.lit(", "), F.col(id_col), F.lit(")"))
        out = out.where(F.raise_error(msg).isNull())
    return out


def adjudicate(disputed: DataFrame, adjudications: DataFrame, id_col: str = "id") -> DataFrame:
    """The adjudicator's label becomes the row label (reason kept)."""
    a = adjudications.select(id_col, "label", F.col("reason").alias("adjudication_reason"))
    return disputed.join(a, id_col, "inner")


def label_lanes_union(votes: DataFrame, adjudications: DataFrame, id_col: str = "id") -> DataFrame:
    """The 'similar' lane unioned with the adjudicated ('checked') lane."""
    s = vote_summary(votes, DEFAULT_ANNOTATORS, id_col)
    similar = s.where("lane = 'similar'").select(id_col, "label", "lane")
    disputed = s.where("lane = 'different'").select(id_col)
    checked = adjudicate(disputed, adjudications, id_col).select(id_col, "label", F.lit("checked").alias("lane"))
    return similar.unionByName(checked)


PAYLOAD_SCHEMA = "text STRING, deepseek STRING, mistral STRING, qwen STRING"


def adjudication_payload(disputed: DataFrame, info: DataFrame, annotators=DEFAULT_ANNOTATORS,
                         id_col: str = "id") -> DataFrame:
    """the adjudicator sees only the text and the votes, as one JSON object."""
    j = info.select(id_col, "text").join(disputed, id_col)
    return j.select(id_col, F.to_json(F.struct("text", *annotators)).alias("payload"))


def review_sheet(labelled: DataFrame, task: str, label_col: str = "label") -> DataFrame:
    """Copy the label into ``<task>_fixed`` with an empty reason for reviewers."""
    return (labelled.withColumn(f"{task}_fixed", F.col(label_col))
                    .withColumn(f"{task}_fixed_reason", F.lit("")))


REPLY_SCHEMA = "label STRING, reason STRING"


def parse_reply(df: DataFrame, raw: str = "raw", strip_fences: bool = False) -> DataFrame:
    """Greedy ``{...}`` extract + JSON parse; a bare newline inside a string is taken as
    part of it, as the source repairs it; unparseable replies go to lane 'error'."""
    obj = tx.extract_json_object(raw, strip_fences)
    parsed = F.from_json(obj, REPLY_SCHEMA, {"allowUnquotedControlChars": "true"})
    out = df.withColumn("_p", parsed)
    ok = F.col("_p.label").isNotNull()
    return (out.withColumn("label", F.col("_p.label")).withColumn("reason", F.col("_p.reason"))
               .withColumn("lane", F.when(ok, "ok").otherwise("error")).drop("_p"))


def drop_vote_columns(df: DataFrame, annotators=DEFAULT_ANNOTATORS) -> DataFrame:
    """production mode keeps only the adjudicated label."""
    cols = [c for c in df.columns if c in annotators or any(c.startswith(a + "_") for a in annotators)]
    return df.drop(*cols)


def without_annotator(sheets: DataFrame, name: str, annotator: str = "annotator") -> DataFrame:
    """F16: the sheets of all annotators but one (the models' file is not reviewed again)."""
    return sheets.where(F.col(annotator) != name)


def undecided(task: str) -> F.Column:
    """the label is the empty string (no decision yet)."""
    return F.col(task) == ""
