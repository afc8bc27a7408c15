"""Facts from annotators' answers: mentions, links and relations out of the JSON of each assignment.

An answer is a list of elements. Its questions come in three kinds: selective relations (two versions of the payload),
exhaustive relations and exhaustive entities. All are read by one schema whose doubtful parts (a type that is a word or
an object, offsets as numbers or text, flags as booleans or words) are text and settled afterwards, so that one pass
over the answers yields all three tables; nothing but the removal of repeats is shuffled.

Defined results: null, empty or unreadable answers, ignored assignments and unknown kinds of questions give no facts;
facts with an empty or inverted span are left out, and so are relations the dictionary lacks; a fact that an
assignment states more than once counts once. A flag holds where it is true or 'Yes'; null counts as absent. Links
lose the `wiki:` they may begin with before they are compared and named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.dictionaries import ALIASES, ENTITY_TYPES
from claimscope.functions.scalars import unquote
from claimscope.operators.annotation import merge_facts, merge_mentions, with_canonical_links
from claimscope.session import written

_PLACE = "gloss:string,span:array<string>,doc_char_begin:string,doc_char_end:string"
_ARG = f"struct<{_PLACE},type:string,entity:struct<{_PLACE},link:string,canonicalCorrect:string,linkCorrect:string,linkGold:string>>"
ELEMENT = f"array<struct<version:string,relation:string,subject:{_ARG},object:{_ARG},{_PLACE},type:string,entity:struct<{_PLACE},link:string>>>"
#: Kinds of questions that can be read.
KINDS = ("selective_relations", "exhaustive_relations", "exhaustive_entities")
#: What an answer means by a relation the dictionary lacks.
_MEANT = {"per:sibling": "per:siblings"}
RELATIONS = sorted(set(ALIASES.values()))

KEY = ["assignment_id", "question_batch_id", "question_id", "doc_id"]


def plain(text: Column) -> Column:
    """No-break spaces, written as they are or as an escape, become spaces."""
    return F.replace(F.replace(text, F.lit("\\u00a0"), F.lit(" ")), F.lit(" "), F.lit(" "))


def _span(x: Column) -> Column:
    lo = F.coalesce(F.get(x["span"], F.lit(0)), x["doc_char_begin"]).try_cast("int")
    hi = F.coalesce(F.get(x["span"], F.lit(1)), x["doc_char_end"]).try_cast("int")
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def _yes(x: Column) -> Column:
    return F.lower(x).isin("true", "yes")


def _page(link: Column) -> Column:
    return unquote(F.regexp_replace(link, "^wiki:", ""))


def _type(x: Column) -> Column:
    return F.trim(F.coalesce(F.get_json_object(x["type"], "$.name"), x["type"]))


def elements(answers: DataFrame) -> DataFrame:
    """(KEY..., batch_type, x): the elements of the readable answers. answers: KEY, batch_type, response and, if the
    table has it, ignored."""
    kept = answers.filter(F.col("batch_type").isin(*KINDS))
    if "ignored" in answers.columns:
        kept = kept.filter(~F.coalesce("ignored", F.lit(False)))
    return kept.select(*KEY, "batch_type", F.explode(F.from_json(plain(F.col("response")), ELEMENT)).alias("x"))


def unread(answers: DataFrame) -> DataFrame:
    """(batch_type, n): answers whose question is of a kind that can't be read, null kinds together."""
    return answers.filter(F.col("batch_type").isNull() | ~F.col("batch_type").isin(*KINDS)).groupBy("batch_type").agg(F.count(F.lit(1)).alias("n"))


def _arguments(each: DataFrame) -> DataFrame:
    """(KEY..., kind, span, canon, type, gloss, canonical_gloss, link, right, link_right, gold): both arguments of selective
    answers (kind 'new' or 'old') and the entities of exhaustive ones (kind 'entity')."""
    def one(x: Column, kind: Column) -> Column:
        e = x["entity"]
        flag = lambda name: e[name] if kind is not _ENTITY else F.lit(None).cast("string")
        return F.struct(
            kind.alias("kind"), _span(x).alias("span"), _span(e).alias("canon"), _type(x).alias("type"), F.trim(x["gloss"]).alias("gloss"), F.trim(e["gloss"]).alias("canonical_gloss"), e["link"].alias("link"),
            flag("canonicalCorrect").alias("right"), flag("linkCorrect").alias("link_right"), flag("linkGold").alias("gold"),
        )

    _ENTITY = F.lit("entity")
    x = F.col("x")
    version = F.when(x["version"].try_cast("double") == 0.2, "new").otherwise("old")
    both = F.array(one(x["subject"], version), one(x["object"], version))
    rows = F.when(F.col("batch_type") == "exhaustive_entities", F.array(one(x, _ENTITY))).when(F.col("batch_type") == "selective_relations", both)
    return each.select(*KEY, F.explode(rows).alias("a")).select(*KEY, "a.*")


def _fits(span: str) -> Column:
    return F.col(f"{span}.lo") < F.col(f"{span}.hi")


def mention_facts(answers: DataFrame) -> DataFrame:
    """(KEY..., lo, hi, c_lo, c_hi, mention_type, gloss, weight): 1 where the canonical mention was confirmed, else 0."""
    a = _arguments(elements(answers)).filter(_fits("span") & _fits("canon")).filter("kind <> 'old' OR right IS NOT NULL")
    weight = F.when((F.col("kind") == "entity") | _yes(F.col("right")), 1.0).otherwise(0.0)
    return a.select(*KEY, "span.lo", "span.hi", F.col("canon.lo").alias("c_lo"), F.col("canon.hi").alias("c_hi"), F.col("type").alias("mention_type"), "gloss", weight.alias("weight")).distinct()


def link_facts(answers: DataFrame) -> DataFrame:
    """(KEY..., lo, hi, link_name, correct, weight): `gloss:` links to the canonical mention's text, true where it was
    confirmed; `wiki:` links, false for a suggested page that was replaced, true for the one chosen, and `wiki:` alone
    where there is no page; `date:` links of dates."""
    a = _arguments(elements(answers)).filter(_fits("span"))
    entity, right = F.col("type").isin(*ENTITY_TYPES), F.coalesce(_yes(F.col("right")), F.lit(False))
    page, gold = _page(F.col("link")), _page(F.col("gold"))
    fact = lambda when, name, correct: F.when(when, F.struct(name.alias("link_name"), correct.alias("correct")))
    wiki = lambda p: F.concat(F.lit("wiki:"), p)
    gloss = F.concat(F.lit("gloss:"), "canonical_gloss")
    new, old, listed, yes = F.col("kind") == "new", F.col("kind") == "old", F.col("kind") == "entity", F.lit(True)
    facts = F.array(
        fact(new & entity | old & F.col("right").isNotNull(), gloss, right),
        fact(new & entity & F.col("link").startswith("wiki:") & (gold.isNull() | (page != gold)), wiki(page), F.lit(False)),
        fact(new & entity & gold.isNotNull(), wiki(gold), yes),
        fact(new & entity & gold.isNull() & right, F.lit("wiki:"), yes),
        fact(old & F.col("link_right").isNotNull(), wiki(page), _yes(F.col("link_right"))),
        fact(listed & entity, wiki(F.coalesce(page, F.lit(""))), yes),
        fact(listed & entity, gloss, yes),
        fact(listed & (F.col("type") == "DATE"), F.concat(F.lit("date:"), page), yes),
    )
    out = a.select(*KEY, "span.lo", "span.hi", F.explode(F.filter(facts, lambda f: f["link_name"].isNotNull())).alias("f"))
    return out.select(*KEY, "lo", "hi", "f.link_name", "f.correct", F.lit(1.0).alias("weight")).distinct()


def relation_facts(answers: DataFrame) -> DataFrame:
    """(KEY..., subject_lo, subject_hi, object_lo, object_hi, relation, weight)."""
    e = elements(answers).filter("batch_type <> 'exhaustive_entities'")
    meant = F.create_map(*[F.lit(v) for kv in _MEANT.items() for v in kv])
    name = F.coalesce(F.try_element_at(meant, F.col("x.relation")), F.col("x.relation"))
    r = e.select(*KEY, _span(F.col("x.subject")).alias("s"), _span(F.col("x.object")).alias("o"), name.alias("relation")).filter(_fits("s") & _fits("o") & F.col("relation").isin(*RELATIONS))
    return r.select(*KEY, F.col("s.lo").alias("subject_lo"), F.col("s.hi").alias("subject_hi"), F.col("o.lo").alias("object_lo"), F.col("o.hi").alias("object_hi"), "relation", F.lit(1.0).alias("weight")).distinct()


def replaced(stored: DataFrame, new: DataFrame, assignments: DataFrame) -> DataFrame:
    """stored facts with those of the given assignments (assignment_id) replaced by new ones."""
    ids = assignments.select("assignment_id").distinct()
    return stored.join(ids, "assignment_id", "left_anti").unionByName(new.join(ids, "assignment_id", "left_semi"))


def in_scope(facts: DataFrame, mode: str, scope: DataFrame | None = None) -> DataFrame:
    """The facts of the documents to merge: `all`, those of a list of documents (scope: doc_id), or all facts of the
    documents that answers to some batches (question_batch_id) or questions (question_batch_id, question_id) speak of."""
    if mode == "all":
        return facts
    keys = {"documents": ["doc_id"], "batches": ["question_batch_id"], "questions": ["question_batch_id", "question_id"]}
    if mode not in keys:
        raise ValueError(f"unknown scope {mode!r}")
    docs = facts.join(scope.select(*keys[mode]).distinct(), keys[mode], "left_semi").select("doc_id").distinct()
    return facts.join(docs, "doc_id", "left_semi")


def expected(facts: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, of): the assignments of all questions in which a key occurs."""
    question = ["question_batch_id", "question_id"]
    asked = answers.groupBy(*question).agg(F.countDistinct("assignment_id").alias("n"))
    return facts.select(*keys, *question).distinct().join(asked, question).groupBy(*keys).agg(F.sum("n").cast("double").alias("of"))


def merged_links(answers: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Links by majority of the answers, and with merged mentions also those to their canonical mention's gloss."""
    links, at = link_facts(answers), ["doc_id", "lo", "hi", "link_name"]
    chosen = merge_facts(links, at, ["correct"], expected(links, answers, at))
    return chosen if mentions is None else with_canonical_links(chosen, mentions)


def merged_relations(answers: DataFrame) -> DataFrame:
    relations, pair = relation_facts(answers), ["doc_id", "subject_lo", "subject_hi", "object_lo", "object_hi"]
    return merge_facts(relations, pair, ["relation"], expected(relations, answers, pair))


def merged(answers: DataFrame) -> dict[str, DataFrame]:
    """The gold tables of the answers; links depend on mentions."""
    mentions = merge_mentions(written(mention_facts(answers), "facts"))  # read by several joins
    return {"mentions": mentions, "links": merged_links(answers, mentions), "relations": merged_relations(answers)}
