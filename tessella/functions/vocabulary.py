"""The relation vocabulary as a table of dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Families by sigma with their inverses; '=' is a family that is its own, '-' one that has none.
FAMILIES = {
    "factual": """part_of(has_part), has_part(part_of), contains(contained_in), contained_in(contains), is_a(has_subtype), has_subtype(is_a),
        instance_of(has_instance), has_instance(instance_of), made_of(material_in), material_in(made_of), has_attribute(attribute_of), attribute_of(has_attribute),
        owns(owned_by), owned_by(owns), operates(operated_by), operated_by(operates), located_in(location_of), location_of(located_in), member_of(has_member),
        has_member(member_of), subsidiary_of(has_subsidiary), has_subsidiary(subsidiary_of), supplies(supplied_by), supplied_by(supplies), regulates(regulated_by),
        regulated_by(regulates), identifies(identified_by), identified_by(identifies), has_role(role_of), role_of(has_role), same_as(=), differs_from(=),
        adjacent_to(=), denominated_in(-)""",
    "temporal": """occurred_at(-), started_at(-), ended_at(-), valid_from(-), valid_until(-), scheduled_for(-), before(after), after(before), during(spans),
        spans(during), supersedes(superseded_by), superseded_by(supersedes), overlaps(=), concurrent_with(=)""",
    "causal": """causes(caused_by), caused_by(causes), enables(enabled_by), enabled_by(enables), prevents(prevented_by), prevented_by(prevents),
        triggers(triggered_by), triggered_by(triggers), contributes_to(has_contributor), has_contributor(contributes_to), depends_on(required_by), required_by(depends_on)""",
    "episodic": """acquired(acquired_by), acquired_by(acquired), divested(divested_by), divested_by(divested), participated_in(had_participant),
        had_participant(participated_in), attended(-), filed(-), announced(-), commissioned(-), decommissioned(-)""",
    "authorial": """authored(authored_by), authored_by(authored), derived_from(has_derivative), has_derivative(derived_from), cites(cited_by), cited_by(cites),
        quotes(quoted_by), quoted_by(quotes), edited(edited_by), edited_by(edited), summarizes(summarized_by), summarized_by(summarizes), attributed_to(-)""",
    "structural": """_follows(_precedes), _precedes(_follows), _co_doc(=), _mentioned_before(-), _session_follows(_session_precedes),
        _session_precedes(_session_follows), _covers_period(-)""",
}
#: Labels that aren't the family's words.
LABELS = {
    "_follows": "follows (reading order)",
    "_precedes": "precedes (reading order)",
    "_co_doc": "same document",
    "_mentioned_before": "mentioned earlier in document",
    "_session_follows": "session follows",
    "_session_precedes": "session precedes",
    "_covers_period": "covers period",
}


def family_rows() -> list[tuple[str, str, str | None, str, bool, bool, int]]:
    """(family, sigma, inverse, label, truth_gated, self_inverse, place) in order."""
    out: list[tuple] = []
    for sigma, text in FAMILIES.items():
        for item in text.replace("\n", " ").split(","):
            family, inverse = item.strip().removesuffix(")").split("(")
            other = {"=": family, "-": None}.get(inverse, inverse)
            out.append((family, sigma, other, LABELS.get(family, family.replace("_", " ")), sigma != "structural", inverse == "=", len(out)))
    return out


def families(spark: SparkSession) -> DataFrame:
    """The vocabulary: a row for each family; edges of all but the structural ones pass the truth gate."""
    return spark.createDataFrame(family_rows(), "family string, sigma string, inverse string, label string, truth_gated boolean, self_inverse boolean, place int")
