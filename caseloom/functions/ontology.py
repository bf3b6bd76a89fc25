"""Labels and ontology metadata of vertices and edges, from their property maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions import standardize as st

#: Property names that decide a vertex's label, first match first.
LABEL_KEYS = (
    ("vt_event", "event_type event_id"), ("vt_persona", "persona_type persona_id"), ("vt_ip", "ip ip_addr ipaddr"), ("vt_atm", "atm atm_id"), ("vt_site", "site url domain"),
    ("vt_bacnt", "actno bank account bacnt"), ("vt_telno", "telno phone"), ("vt_file", "file filename filepath"), ("vt_flnm", "flnm"), ("vt_id", "id user_id userid"), ("vt_psn", "name"),
)
#: Concept class by property names, first match first.
CONCEPT_KEYS = (("Case", "flnm"), ("BankAccount", "actno bank account bacnt"), ("Phone", "telno phone"), ("NetworkTrace", "ip ip_addr"), ("Person", "name"))
#: Old label or edge name to the current one.
ALIASES = {"vt_flnm": "vt_case", "used_account": "eg_used_account", "used_phone": "eg_used_phone"}
#: Properties that name a vertex, first match first.
NAME_KEYS = ("name", "flnm", "actno", "telno", "ip_addr", "site", "filename", "event_id", "id")


def has_any(props: Column, names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.map_contains_key(props, n) for n in names.split()])


def first_of(props: Column, names) -> Column:
    """first listed property that is neither null nor empty."""
    return F.coalesce(*[F.nullif(props[n], F.lit("")) for n in names])


def node_label(props: Column) -> Column:
    """label from the names of the properties; vt_psn if none decides."""
    c = F
    for label, names in LABEL_KEYS:
        c = c.when(has_any(props, names), label)
    return F.coalesce(c.otherwise("vt_psn"), F.lit("vt_psn"))


def concept(props: Column) -> Column:
    """concept class from the names of the properties."""
    c = F
    for name, names in CONCEPT_KEYS:
        c = c.when(has_any(props, names), name)
    return c.otherwise("Other")


def current_name(c: Column) -> Column:
    """Old dialect names as the current ones."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[c], c)


def edge_label(props: Column) -> Column:
    """lower-cased first of the properties that can name a relation, else related_to."""
    return F.lower(F.coalesce(first_of(props, ("semantic_relation", "domain_meaning", "edge_type", "type")), F.lit("related_to")))


def enrich(label: Column, props: Column) -> Column:
    """standard codes added to the properties of accounts, phones and files."""
    add = lambda k, v: F.map_filter(F.create_map(F.lit(k), v), lambda _, x: x.isNotNull())
    bank = st.bank_code(first_of(props, ("bank_cd", "bank", "bank_nm", "은행")))
    carrier = st.carrier_code(first_of(props, ("carrier", "carr", "통신사")))
    rest = F.map_filter(props, lambda k, _: ~k.isin("hash_alg", "bnk_cd", "carr_cd"))
    algorithm = F.coalesce(st.hash_algorithm(first_of(props, ("hash_alg", "hash_algorithm"))), F.lit("SHA256"))
    no_hash = F.when(F.coalesce(props["hash_val"], F.lit("")) == "", F.lit("E09"))
    files = F.map_concat(F.map_filter(rest, lambda k, _: k != "evd_cd"), add("hash_alg", algorithm), add("evd_cd", F.coalesce(no_hash, props["evd_cd"])))
    return F.when(label == "vt_bacnt", F.map_concat(rest, add("bnk_cd", F.coalesce(bank, props["bnk_cd"])))).when(label == "vt_telno", F.map_concat(rest, add("carr_cd", F.coalesce(carrier, props["carr_cd"])))).when(label == "vt_file", files).otherwise(props)


def sentence(src: Column, label: Column, props: Column, dst: Column) -> Column:
    """an edge as 'src -[label: k=v, ...]-> dst', empty values and bookkeeping left out."""
    kept = F.map_filter(props, lambda k, v: ~k.isin("source", "updated") & (F.coalesce(v, F.lit("")) != ""))
    text = F.array_join(F.transform(F.sort_array(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.concat(src, F.lit(" -["), label, F.when(text != "", F.concat(F.lit(": "), text)).otherwise(""), F.lit("]-> "), dst)
