"""Relaxed functional dependencies and query relaxation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .functions.bench import append_results, bench_results, bench_summary, measure_discovery
from .functions.metrics import choose_metrics, distance, within
from .operators.check import rfd_edges, rfd_holds, rfd_nodes, rfd_violations
from .operators.discover import discover, discover_all, rfd_intervals, rfd_points, rfd_single
from .operators.extent import max_clique, rfd_extent
from .operators.pairs import (
    distance_medians, median_sketches, pair_distances, side_combinations, sketch_error, sketched_medians, split_sides)
from .operators.query import Predicate, QuerySpec, extend_query
from .operators.relax import (
    extent_pct, mark_rows, relax_best, relax_columns, relax_counts, relax_rows, relaxing_attributes)
from .operators.rfd import (
    RFD_SCHEMA, Rfd, filter_rfds, first_rfds, format_rfd, make_rfds, name_rhs, rank_rfds, rfd_threshold,
    rfds_from_wide, rfds_to_wide, union_wide)
from .operators.simjoin import similar_values, similarity_join, string_pairs
from .operators.skyline import dominates, skyline
from .operators.taxonomy import ancestor_maps, ancestors, taxonomy_distance, taxonomy_pairs
from .operators.values import (
    column_values, format_islands, is_consecutive, sort_table, value_islands)
from .session import materialize, shared_dir
from .sources.rfd_files import read_rfds, write_rfds
from .sources.tables import (
    Dialect, columns_with_role, read_table, sniff_csv, table_profile, with_row_id, write_table)
from .streaming.topk import (
    MESSAGE_SCHEMA, divert_stream, diverted, parse_messages, stream_project, stream_source, stream_topk, tweet_fields, write_stream)
