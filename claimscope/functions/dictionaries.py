"""Types and relations of the domain. Small fixed tables; as DataFrames they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types of the task definition, and the named-entity types they stand for.
NER_TYPES = {
    "PERSON": "PER",
    "ORGANIZATION": "ORG",
    "GPE": "GPE",
    "CITY": "GPE",
    "STATE_OR_PROVINCE": "GPE",
    "COUNTRY": "GPE",
    "LOCATION": "GPE",
    "TITLE": "TITLE",
    "DATE": "DATE",
}
ENTITY_TYPES = ("PER", "ORG", "GPE")
STRING_TYPES = ("DATE", "TITLE")
# Canonical relation -> (subject type, object types).
CANONICAL = {
    "per:place_of_birth": ("PER", ("GPE",)),
    "per:place_of_residence": ("PER", ("GPE",)),
    "per:place_of_death": ("PER", ("GPE",)),
    "per:date_of_birth": ("PER", ("DATE",)),
    "per:date_of_death": ("PER", ("DATE",)),
    "per:organizations_founded": ("PER", ("ORG",)),
    "per:holds_shares_in": ("PER", ("ORG",)),
    "per:schools_attended": ("PER", ("ORG",)),
    "per:employee_or_member_of": ("PER", ("ORG", "GPE")),
    "per:parents": ("PER", ("PER",)),
    "per:children": ("PER", ("PER",)),
    "per:spouse": ("PER", ("PER",)),
    "per:siblings": ("PER", ("PER",)),
    "per:other_family": ("PER", ("PER",)),
    "per:title": ("PER", ("TITLE",)),
    "org:place_of_headquarters": ("ORG", ("GPE",)),
    "org:date_founded": ("ORG", ("DATE",)),
    "org:date_dissolved": ("ORG", ("DATE",)),
    "org:founded_by": ("ORG", ("PER", "ORG", "GPE")),
    "org:member_of": ("ORG", ("ORG",)),
    "org:members": ("ORG", ("ORG", "GPE")),
    "org:subsidiaries": ("ORG", ("ORG",)),
    "org:parents": ("ORG", ("ORG", "GPE")),
    "org:shareholders": ("ORG", ("PER", "ORG", "GPE")),
    "org:holds_shares_in": ("ORG", ("ORG",)),
}
NO_RELATION = "no_relation"
# Argument types of the two relations that only occur as inverses.
ONLY_INVERSE = {
    "org:employees_or_members": ("ORG", ("PER",)),
    "org:students": ("ORG", ("PER",)),
}
# Relation -> its inverses; which one holds follows from the object's type, the prefix of the inverse.
INVERSES = {
    "per:children": ("per:parents",),
    "per:other_family": ("per:other_family",),
    "per:parents": ("per:children",),
    "per:siblings": ("per:siblings",),
    "per:spouse": ("per:spouse",),
    "per:employee_or_member_of": ("org:employees_or_members", "gpe:employees_or_members"),
    "per:schools_attended": ("org:students",),
    "per:place_of_birth": ("gpe:births_in_place",),
    "per:place_of_residence": ("gpe:residents_in_place",),
    "per:place_of_death": ("gpe:deaths_in_place",),
    "per:organizations_founded": ("org:founded_by",),
    "per:holds_shares_in": ("org:shareholders",),
    "org:shareholders": ("per:holds_shares_in", "org:holds_shares_in", "gpe:holds_shares_in"),
    "org:holds_shares_in": ("org:shareholders",),
    "org:founded_by": ("per:organizations_founded", "org:organizations_founded", "gpe:organizations_founded"),
    "org:organizations_founded": ("org:founded_by",),
    "org:employees_or_members": ("per:employee_or_member_of",),
    "org:member_of": ("org:members",),
    "org:members": ("gpe:member_of", "org:member_of"),
    "org:students": ("per:schools_attended",),
    "org:subsidiaries": ("org:parents",),
    "org:parents": ("org:subsidiaries",),
    "org:place_of_headquarters": ("gpe:headquarters_in_place",),
    "gpe:births_in_place": ("per:place_of_birth",),
    "gpe:residents_in_place": ("per:place_of_residence",),
    "gpe:deaths_in_place": ("per:place_of_death",),
    "gpe:employees_or_members": ("per:employee_or_member_of",),
    "gpe:holds_shares_in": ("org:shareholders",),
    "gpe:organizations_founded": ("org:founded_by",),
    "gpe:member_of": ("org:members",),
    "gpe:headquarters_in_place": ("org:place_of_headquarters",),
    "gpe:subsidiaries": ("org:parents",),
}
# Every accepted name -> the relation it stands for.
ALIASES = {
    "no_relation": "no_relation",
    "per:children": "per:children",
    "per:date_of_birth": "per:date_of_birth",
    "per:date_of_death": "per:date_of_death",
    "per:employee_or_member_of": "per:employee_or_member_of",
    "per:top_member_employee_of": "per:employee_or_member_of",
    "per:holds_shares_in": "per:holds_shares_in",
    "per:organizations_founded": "per:organizations_founded",
    "per:other_family": "per:other_family",
    "per:parents": "per:parents",
    "per:place_of_birth": "per:place_of_birth",
    "per:city_of_birth": "per:place_of_birth",
    "per:country_of_birth": "per:place_of_birth",
    "per:stateorprovince_of_birth": "per:place_of_birth",
    "per:place_of_death": "per:place_of_death",
    "per:city_of_death": "per:place_of_death",
    "per:country_of_death": "per:place_of_death",
    "per:stateorprovince_of_death": "per:place_of_death",
    "per:place_of_residence": "per:place_of_residence",
    "per:cities_of_residence": "per:place_of_residence",
    "per:countries_of_residence": "per:place_of_residence",
    "per:stateorprovinces_of_residence": "per:place_of_residence",
    "per:schools_attended": "per:schools_attended",
    "per:siblings": "per:siblings",
    "per:spouse": "per:spouse",
    "per:title": "per:title",
    "org:date_dissolved": "org:date_dissolved",
    "org:date_founded": "org:date_founded",
    "org:employees_or_members": "org:employees_or_members",
    "org:top_members_employees": "org:employees_or_members",
    "org:founded_by": "org:founded_by",
    "org:holds_shares_in": "org:holds_shares_in",
    "org:member_of": "org:member_of",
    "org:members": "org:members",
    "org:organizations_founded": "org:organizations_founded",
    "org:parents": "org:parents",
    "org:place_of_headquarters": "org:place_of_headquarters",
    "org:city_of_headquarters": "org:place_of_headquarters",
    "org:country_of_headquarters": "org:place_of_headquarters",
    "org:stateorprovince_of_headquarters": "org:place_of_headquarters",
    "org:shareholders": "org:shareholders",
    "org:students": "org:students",
    "org:subsidiaries": "org:subsidiaries",
    "gpe:births_in_place": "gpe:births_in_place",
    "gpe:births_in_city": "gpe:births_in_place",
    "gpe:births_in_country": "gpe:births_in_place",
    "gpe:births_in_stateorprovince": "gpe:births_in_place",
    "gpe:deaths_in_place": "gpe:deaths_in_place",
    "gpe:deaths_in_city": "gpe:deaths_in_place",
    "gpe:deaths_in_country": "gpe:deaths_in_place",
    "gpe:deaths_in_stateorprovince": "gpe:deaths_in_place",
    "gpe:employees_or_members": "gpe:employees_or_members",
    "gpe:headquarters_in_place": "gpe:headquarters_in_place",
    "gpe:headquarters_in_city": "gpe:headquarters_in_place",
    "gpe:headquarters_in_country": "gpe:headquarters_in_place",
    "gpe:headquarters_in_stateorprovince": "gpe:headquarters_in_place",
    "gpe:holds_shares_in": "gpe:holds_shares_in",
    "gpe:member_of": "gpe:member_of",
    "gpe:organizations_founded": "gpe:organizations_founded",
    "gpe:residents_in_place": "gpe:residents_in_place",
    "gpe:residents_of_city": "gpe:residents_in_place",
    "gpe:residents_of_country": "gpe:residents_in_place",
    "gpe:residents_of_stateorprovince": "gpe:residents_in_place",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a fixed table, null where it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def inverse(relation: Column, object_type: Column) -> Column:
    """The inverse relation for an object of a type, null where there is none."""
    out = F.lit(None).cast("string")
    for name, several in INVERSES.items():
        for inv in several:
            out = F.when((relation == name) & (F.lower(object_type) == inv[:3]), inv).otherwise(out)
    return out


def is_canonical(relation: Column, subject_type: Column, object_type: Column) -> Column:
    """Whether a relation may stay as it is: canonical, and not an organisation's relation to a person."""
    return relation.isin(*CANONICAL, NO_RELATION) & ((subject_type == "PER") | (object_type != "PER"))


def argument_types(spark: SparkSession) -> DataFrame:
    """(relation, subject_type, object_type), one row per admitted combination."""
    rows = [(r, s, o) for r, (s, objects) in (CANONICAL | ONLY_INVERSE).items() for o in objects]
    return spark.createDataFrame(rows, "relation string, subject_type string, object_type string")


def pair_types() -> list[tuple[str, str]]:
    """Type pairs to ask about: each unordered pair once, PER before ORG before GPE as subject."""
    order = {"PER": 0, "ORG": 1, "GPE": 2}
    pairs = {(s, o) for s, objects in (CANONICAL | ONLY_INVERSE).values() for o in objects}
    return sorted(p for p in pairs if order[p[0]] <= order.get(p[1], 3))
