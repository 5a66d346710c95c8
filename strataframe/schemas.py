"""Schemas of the tables that the operators read, as DDL, for readers of formats without one."""

from __future__ import annotations

from pyspark.sql.types import StructType

_ITEM = "_id STRING, title STRING, description STRING, facetId STRING, groupId STRING, sortKey STRING, flags INT, timeCreated TIMESTAMP_NTZ, creatorId STRING, timeModified TIMESTAMP_NTZ, userId STRING"
_PART = "_id STRING, itemId STRING, typeId STRING, roleId STRING, timeCreated TIMESTAMP_NTZ, creatorId STRING, timeModified TIMESTAMP_NTZ, userId STRING, content STRING"
_VERSION = "referenceId STRING, status INT"
_ARRIVAL = "arrivedAt TIMESTAMP_NTZ"

TABLES = {
    "items": f"{_ITEM}, {_ARRIVAL}",
    "history_items": f"{_ITEM}, {_VERSION}, {_ARRIVAL}",
    "parts": f"{_PART}, {_ARRIVAL}",
    "history_parts": f"{_PART}, {_VERSION}, {_ARRIVAL}",
    "thesauri": "id STRING, entries ARRAY<STRUCT<id: STRING, value: STRING>>, targetId STRING",
    "namespace_lookup": "id STRING, uri STRING",
    "uri_lookup": "id INT, uri STRING",
    "uid_lookup": "id INT, sid STRING, unsuffixed STRING, has_suffix BOOLEAN",
    "node": "id INT, is_class BOOLEAN, tag STRING, label STRING, source_type INT, sid STRING",
    "node_class": "id INT, node_id INT, class_id INT, level INT",
    "property": "id INT, data_type STRING, lit_editor STRING, description STRING",
    "triple": "id INT, s_id INT, p_id INT, o_id INT, o_lit STRING, o_lit_type STRING, o_lit_lang STRING, o_lit_ix STRING, o_lit_n DOUBLE, sid STRING, tag STRING",
    "mapping": "id INT, ordinal INT, name STRING, source_type INT, facet_filter STRING, group_filter STRING, title_filter STRING, flags_filter INT, part_type_filter STRING, part_role_filter STRING, description STRING, source STRING, sid STRING, scalar_pattern STRING",
    "mapping_link": "parent_id INT, child_id INT",
    "mapping_out_node": "id INT, mapping_id INT, ordinal INT, name STRING, uid STRING, label STRING, tag STRING",
    "mapping_out_triple": "id INT, mapping_id INT, ordinal INT, s STRING, p STRING, o STRING, ol STRING",
    "mapping_out_meta": "id INT, mapping_id INT, ordinal INT, name STRING, value STRING",
    "item_dump": "dump_id BIGINT, doc STRING",
    "thesaurus_csv": "file_no INT, line_no INT, raw STRING",
    "load_runs": "run_id INT, coll STRING, startedAt TIMESTAMP_NTZ, readUpTo TIMESTAMP_NTZ, finishedAt TIMESTAMP_NTZ, outcome STRING",
    "segments": "item_id STRING, n INT, start INT, end INT, fragment_ids ARRAY<STRING>, text STRING, eol BOOLEAN, features ARRAY<STRUCT<name: STRING, value: STRING>>",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
