"""Triple-pattern analytics on Spark DataFrames."""

from tripleweft.operators.dictionary import (
    build_dictionary,
    decode_bindings,
    encode_patterns,
    encode_query,
    encode_triples,
    expand_curies,
    extend_dictionary,
)
from tripleweft.operators.filters import (
    build_all_filters,
    build_bloom_filter,
    build_exact_filter,
    candidate_properties,
    common_filter,
    probe_bloom,
    probe_exact,
    union_filters,
    verify_properties,
    workload_candidates,
    write_filters,
)
from tripleweft.operators.joins import join_bindings, join_unbound_property, semi_join, semi_join_or_null
from tripleweft.operators.layout import intersect_properties, partition_by, union_properties
from tripleweft.operators.patterns import match_pattern
from tripleweft.operators.reductions import (
    candidate_rows,
    exact_filters,
    find_partners,
    partner_keys,
    read_pattern,
    reduce_object,
    reduce_pattern,
    reduce_subject,
    reduction_keys,
    reduction_names,
    shared_keys,
    workload_reductions,
)
from tripleweft.operators.stats import (
    count_results,
    dataset_stats,
    distinct_terms,
    property_stats,
)
from tripleweft.plans.bgp import bgp, project, reduced_bgp
from tripleweft.plans.stores import create_store, open_store
from tripleweft.plans.workload import count_solutions, pattern_shapes, pattern_table, workload_report, write_workload
from tripleweft.session import configure, materialize
from tripleweft.sources.ntriples import (
    export_dictionary,
    read_encoded,
    read_ntriples,
    read_prefixes,
    refused_lines,
    write_encoded,
)
from tripleweft.sources.properties import PropertyStore, scan_properties, version_of, write_properties
from tripleweft.sources.reductions import read_catalog, read_reduction, read_stored, recorded_sizes, write_reductions

__all__ = [name for name in dir() if not name.startswith("_")]
