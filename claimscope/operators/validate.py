"""Validation and symmetrisation of statements (see sources.kbfiles): clean tables and a table of issues.

Every rule is a set operation on keys with line numbers, so order dependence ("the first definition wins") doesn't
depend on partitions. Tables that several rules read are checkpointed, so that no rule repeats the work of those
before it. Issues are rows (code, level, line, details); level follows from the code's letter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.dictionaries import argument_types, inverse, is_canonical
from claimscope.session import checkpointed

PROV = "struct<doc_id:string,lo:int,hi:int>"


@dataclass
class Clean:
    mentions: DataFrame
    links: DataFrame
    canonical: DataFrame
    relations: DataFrame
    issues: DataFrame


def _issue(df: DataFrame, code: str, details: Column) -> DataFrame:
    level = {"E": "error", "W": "warning", "I": "info"}[code[0]]
    return df.select(F.lit(code).alias("code"), F.lit(level).alias("level"), F.col("line"), details.cast("string").alias("details"))


def _text(prov: str) -> Column:
    return F.format_string("%s:%d-%d", f"{prov}.doc_id", f"{prov}.lo", f"{prov}.hi")


def _firsts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each row beside the first row of its key."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct("line", *columns), "line").alias("_f"))
    return df.join(first, keys)


def _first_wins(df: DataFrame, keys: list[str], columns: list[str], codes: dict[str, str]) -> tuple[DataFrame, list[DataFrame]]:
    """First rows, and issues of later ones: a code for each column that differs, W09 where none does."""
    j = _firsts(df, keys, columns)
    kept = j.filter("line = _f.line").drop("_f")
    later = j.filter("line > _f.line")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f.{c}")) for c in columns])
    issues = [_issue(later.filter(~F.col(c).eqNullSafe(F.col(f"_f.{c}"))), code, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c, code in codes.items()]
    return kept, [*issues, _issue(later.filter(same), "W09", _text("subject"))]


def validate(statements: DataFrame, doc_ids: DataFrame | None = None, same_nil: bool = False) -> Clean:
    """All rules in turn. doc_ids: (doc_id) of the corpus, none for any. same_nil: give every mention without a link
    the one link NILX0 instead of one of its own."""
    spark = statements.sparkSession
    statements = checkpointed(statements)
    issues = [_issue(statements.filter("kind = 'bad'"), "E01", F.col("relation"))]
    s = statements.filter("kind <> 'bad'")
    lacking = s.filter("subject IS NULL")
    issues.append(_issue(lacking, "E02", F.col("kind")))
    s = s.filter("subject IS NOT NULL")
    unknown = s.filter("kind = 'relation' AND relation IS NULL")
    issues.append(_issue(unknown, "I32", _text("subject")))
    s = s.filter("NOT (kind = 'relation' AND relation IS NULL)")

    if doc_ids is not None:
        ids = doc_ids.select(F.col("doc_id").alias("_d")).distinct()
        inside = s.join(ids, F.col("subject.doc_id") == F.col("_d"), "left_semi")
        issues.append(_issue(s.join(ids, F.col("subject.doc_id") == F.col("_d"), "left_anti"), "I31", _text("subject")))
        s = inside

    s = checkpointed(s)
    mentions, more = _first_wins(s.filter("kind = 'mention'"), ["subject"], ["relation", "object"], {"relation": "E11", "object": "E12"})
    mentions = checkpointed(mentions)
    issues += more

    c = s.filter("kind = 'canonical' AND object_prov IS NOT NULL")
    issues.append(_issue(c.filter("subject.doc_id <> object_prov.doc_id"), "W06", _text("subject")))
    canonical, more = _first_wins(c.filter("subject.doc_id = object_prov.doc_id"), ["subject"], ["object_prov"], {"object_prov": "E13"})
    issues += more

    k = s.filter("kind = 'link'")
    issues.append(_issue(k.filter(F.col("object").rlike("^NILX")), "W08", F.col("object")))
    j = _firsts(k, ["subject"], ["object"])
    issues.append(_issue(j.filter("object <> _f.object"), "E14", F.col("object")))
    weights = j.filter("object = _f.object").groupBy("subject").agg(F.max_by("weight", "line").alias("weight"))
    links = j.filter("line = _f.line").drop("_f", "weight").join(weights, "subject")

    r = s.filter("kind = 'relation' AND object_prov IS NOT NULL")
    issues.append(_issue(r.filter("subject = object_prov"), "E03", _text("subject")))
    r = r.filter("subject <> object_prov")
    apart = (F.col("subject.doc_id") != F.col("object_prov.doc_id")) | F.exists("provenances", lambda p: p.doc_id != F.col("subject.doc_id"))
    issues.append(_issue(r.filter(apart), "W07", _text("subject")))
    r = r.filter(~apart)
    j = _firsts(r, ["subject", "object_prov"], ["relation"])
    issues.append(_issue(j.filter("relation <> _f.relation"), "E15", F.col("relation")))
    last = j.filter("relation = _f.relation").groupBy("subject", "object_prov").agg(F.max_by(F.struct("provenances", "weight"), "line").alias("_l"))
    relations = j.filter("line = _f.line").drop("_f", "provenances", "weight").join(last, ["subject", "object_prov"]).select("line", "subject", "relation", "object_prov", "_l.provenances", "_l.weight")
    issues.append(_issue(relations.filter(F.size("provenances") == 0), "W25", _text("subject")))
    cover = F.array(F.struct(F.col("subject.doc_id").alias("doc_id"), F.least("subject.lo", "object_prov.lo").alias("lo"), F.greatest("subject.hi", "object_prov.hi").alias("hi")).cast(PROV))
    relations = relations.withColumn("provenances", F.when(F.size("provenances") == 0, cover).otherwise(F.col("provenances")))

    canonical, links, relations = map(checkpointed, (canonical, links, relations))
    # what refers to no mention goes; what a mention lacks is added
    known = mentions.select(F.col("subject").alias("_m"))
    semi = lambda df, column, how: df.join(known, F.col(column) == F.col("_m"), how)
    for name, df in (("canonical", canonical), ("link", links), ("relation", relations)):
        bad = semi(df, "subject", "left_anti")
        if name != "link":
            bad = bad.unionByName(semi(semi(df, "subject", "left_semi"), "object_prov", "left_anti"))
        issues.append(_issue(bad, "E22", F.concat(F.lit(name + " "), _text("subject"))))
    canonical = semi(semi(canonical, "subject", "left_semi"), "object_prov", "left_semi")
    links = semi(links, "subject", "left_semi")
    relations = semi(semi(relations, "subject", "left_semi"), "object_prov", "left_semi")

    own = mentions.join(canonical.select("subject"), "subject", "left_anti")
    issues.append(_issue(own, "W27", _text("subject")))
    canonical = canonical.select("line", "subject", "object_prov", "weight").unionByName(own.select("line", "subject", F.col("subject").alias("object_prov"), F.lit(0.0).alias("weight")))
    missing = mentions.join(links.select("subject"), "subject", "left_anti")
    issues.append(_issue(missing, "W29", _text("subject")))
    nil = F.lit("NILX0") if same_nil else F.concat(F.lit("NILX"), F.substring(F.md5(_text("subject")), 1, 12))
    links = links.select("line", "subject", "object", "weight").unionByName(missing.select("line", "subject", nil.alias("object"), F.lit(0.0).alias("weight")))
    kinds = mentions.select(F.col("subject").alias("_m"), F.col("relation").alias("_t"))
    links = links.join(kinds, F.col("subject") == F.col("_m")).withColumn("object", F.when((F.col("_t") == "DATE") & ~F.col("object").startswith("date:"), F.concat(F.lit("date:"), F.col("object"))).otherwise(F.col("object"))).drop("_m", "_t")

    # argument types, in the canonical direction
    typed = relations.join(kinds.select(F.col("_m").alias("_sm"), F.col("_t").alias("subject_type")), F.col("subject") == F.col("_sm")).join(kinds.select(F.col("_m").alias("_om"), F.col("_t").alias("object_type")), F.col("object_prov") == F.col("_om")).drop("_sm", "_om")
    stays = is_canonical(F.col("relation"), F.col("subject_type"), F.col("object_type"))
    inv = inverse(F.col("relation"), F.col("object_type"))
    checked = typed.withColumn("_r", F.when(stays | inv.isNull(), F.col("relation")).otherwise(inv)).withColumn("_flip", ~stays & inv.isNotNull())
    checked = checked.withColumns({"_st": F.when(F.col("_flip"), F.col("object_type")).otherwise(F.col("subject_type")), "_ot": F.when(F.col("_flip"), F.col("subject_type")).otherwise(F.col("object_type"))})
    admitted = F.broadcast(argument_types(spark).select(F.col("relation").alias("_r"), F.col("subject_type").alias("_st"), F.col("object_type").alias("_ot")))
    checked = checkpointed(checked)
    issues.append(_issue(checked.join(admitted, ["_r", "_st", "_ot"], "left_anti"), "E04", F.concat_ws(" ", "relation", "subject_type", "object_type")))
    good = checked.join(admitted, ["_r", "_st", "_ot"], "left_semi")

    # both directions of every relation; of two that disagree the one stated first holds
    forward = good.select("line", "subject", "relation", "object_prov", "provenances", "weight", F.lit(0).alias("_added"))
    back = good.filter(inv.isNotNull()).select("line", F.col("object_prov").alias("subject"), inv.alias("relation"), F.col("subject").alias("object_prov"), "provenances", "weight", F.lit(1).alias("_added"))
    both = forward.unionByName(back)
    best = both.groupBy("subject", "object_prov").agg(F.min(F.struct("line", "_added", "relation")).alias("_b"), F.min("_added").alias("_stated"))
    j = checkpointed(both.join(best, ["subject", "object_prov"]))
    issues.append(_issue(j.filter("relation <> _b.relation"), "E16", F.col("relation")))
    final = j.filter("line = _b.line AND _added = _b._added")
    issues.append(_issue(final.filter("_stated = 1"), "W28", F.concat_ws(" ", _text("subject"), F.col("relation"))))
    relations = final.select("line", "subject", "relation", "object_prov", "provenances", "weight")
    return Clean(mentions.select("line", "subject", "relation", "object", "weight"), links, canonical, relations, reduce(DataFrame.unionByName, issues))


def resolve_entities(statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity-centric statements as five-column ones, with issues. A mention claimed by several entities stays with
    the first; entities without a type go; a relation's arguments are the first mention of each entity at or after a
    provenance, in the order of the provenances."""
    statements = checkpointed(statements)
    issues = [_issue(statements.filter("kind = 'bad'"), "E01", F.lit("columns"))]
    types = statements.filter("kind = 'type'").groupBy("entity").agg(F.min_by("object", "line").alias("type"))
    m = statements.filter("kind IN ('mention', 'canonical') AND size(provenances) > 0").withColumn("prov", F.get("provenances", F.lit(0)))
    issues.append(_issue(m.join(types, "entity", "left_anti"), "E21", F.col("entity")))
    m = m.join(types, "entity")
    j = _firsts(m, ["prov"], ["entity"])
    issues.append(_issue(j.filter("entity <> _f.entity"), "E11", F.col("entity")))
    owned = j.filter("entity = _f.entity")
    mention = checkpointed(owned.groupBy("entity", "type", "prov").agg(F.min_by("object", "line").alias("gloss"), F.min("line").alias("line")))
    stated = owned.filter("kind = 'canonical'").groupBy("entity", F.col("prov.doc_id").alias("doc_id")).agg(F.min_by("prov", "line").alias("canon"))
    fallback = mention.groupBy("entity", F.col("prov.doc_id").alias("doc_id")).agg(F.min("prov").alias("least"))
    canon = fallback.join(stated, ["entity", "doc_id"], "left").select("entity", "doc_id", F.coalesce("canon", "least").alias("canon"))

    rel = statements.filter("kind = 'relation' AND relation IS NOT NULL")
    each = rel.select("line", "entity", "relation", F.col("object").alias("other"), "provenances", "weight", F.posexplode("provenances").alias("pos", "p"))

    def argument(side: str) -> DataFrame:
        at = mention.select(F.col("entity").alias(side), "prov")
        found = each.join(at, side).filter("prov.doc_id = p.doc_id AND prov.lo >= p.lo")
        return found.groupBy("line").agg(F.min_by("prov", F.struct("pos", F.col("prov"))).alias(f"_{side}"))

    args = rel.select("line", "entity", "relation", F.col("object").alias("other"), "provenances", "weight").join(argument("entity"), "line", "left").join(argument("other"), "line", "left")
    args = checkpointed(args)
    issues.append(_issue(args.filter("_entity IS NULL OR _other IS NULL"), "W26", F.concat_ws(" ", "entity", "other")))
    ok = args.filter("_entity IS NOT NULL AND _other IS NOT NULL")
    none = F.array().cast(f"array<{PROV}>")
    row = lambda df, kind, subject, relation, obj, oprov, provs, w: df.select("line", F.lit(kind).alias("kind"), subject.cast(PROV).alias("subject"), relation.alias("relation"), obj.cast("string").alias("object"), oprov.cast(PROV).alias("object_prov"), provs.alias("provenances"), w.alias("weight"))
    nothing = F.lit(None)
    out = row(mention, "mention", F.col("prov"), F.col("type"), F.col("gloss"), nothing, none, F.lit(1.0))
    out = out.unionByName(row(mention, "link", F.col("prov"), F.lit("link"), F.col("entity"), nothing, none, F.lit(1.0)))
    with_canon = mention.withColumn("doc_id", F.col("prov.doc_id")).join(canon, ["entity", "doc_id"])
    out = out.unionByName(row(with_canon, "canonical", F.col("prov"), F.lit("canonical_mention"), nothing, F.col("canon"), none, F.lit(1.0)))
    out = out.unionByName(row(ok, "relation", F.col("_entity"), F.col("relation"), nothing, F.col("_other"), F.col("provenances"), F.col("weight")))
    return out, reduce(DataFrame.unionByName, issues)
