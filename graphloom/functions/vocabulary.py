"""Names, synonyms and word lists that results depend on."""

from __future__ import annotations

#: Synonyms of a relationship type, by type; anything else is USES.
RELATIONSHIP_TYPES = {
    "READS_FROM": ("reads_from", "reads", "read_from", "from", "source", "input_from"),
    "WRITES_TO": ("writes_to", "writes", "write_to", "into", "target", "output_to"),
    "TRANSFORMS": ("transforms", "transform"),
    "JOINS_WITH": ("joins_with", "joins", "join"),
    "DERIVES_FROM": ("derives_from", "derives", "derived_from"),
    "CALLS": ("calls", "executes", "performs"),
    "CONTAINS": ("contains", "has", "has_column"),
    "DEPENDS_ON": ("depends_on", "dependency"),
    "MAPS_TO": ("maps_to", "maps"),
    "USES": ("uses", "references"),
    "FILTERS": ("filters", "where"),
    "AGGREGATES": ("aggregates", "group_by"),
    "CALCULATES": ("calculates", "computes"),
    "REPORTS": ("reports",),
}
#: Synonyms of an entity type, by type; anything else is TABLE.
ENTITY_TYPES = {
    "TABLE": ("table", "tables"),
    "COLUMN": ("column", "columns", "field"),
    "PROGRAM": ("program",),
    "PACKAGE": ("package",),
    "TASK": ("task", "data_flow"),
    "PROCEDURE": ("procedure", "stored_procedure"),
    "VIEW": ("view",),
    "VARIABLE": ("variable",),
    "FILE": ("file", "flat_file"),
    "COPYBOOK": ("copybook",),
    "DATABASE": ("database",),
}
#: Node labels that are kept, with a capital; anything else is Entity.
NODE_LABELS = ("table", "column", "program", "package", "task", "procedure", "view", "variable", "file", "copybook", "database", "report", "system", "application", "process")
#: Prefixes of which one is taken off a name before names are compared, the first that fits.
NAME_PREFIXES = ("pcx_", "pc_", "ccx_", "cc_", "bc_", "ab_")
#: Source type and parser of a file, by extension.
EXTENSIONS = {".cbl": "cobol", ".cob": "cobol", ".cpy": "cobol", ".dtsx": "ssis", ".sql": "sql"}
CHUNK_EXTENSIONS = {".sql": "sql", ".dtsx": "ssis", ".cbl": "cobol", ".cpy": "cobol", ".py": "python", ".xml": "xml"}

#: Words of a question by intent; the first intent with a word that stands anywhere in the question wins.
INTENTS = {
    "calculation": ("calculate", "formula", "computation", "how is", "sum", "math", "earned premium", "written premium"),
    "lineage": ("trace", "data flow", "flow from", "where does", "writes", "reads", "producer", "source of", "feed", "populate", "pipeline"),
    "impact_analysis": ("affect", "impact", "change", "if changed", "consequence"),
    "relationship": ("relate", "connect", "between", "link", "tie", "dependency", "dependencies"),
    "source_lookup": ("consume", "which program", "which file", "who creates", "where is", "find program", "which ssis", "which sql", "which cobol", "packages", "package"),
    "definition": ("what is", "define", "meaning", "definition"),
    "comparison": ("differ", "compare", "versus", "vs"),
    "validation": ("business rule", "commercial auto", "rating rule", "valid", "check", "rule", "constraint", "validation", "error code"),
}
#: Words that say nothing about what a question is after, and the few of them that always go.
STOP_TERMS = "what when where which who whom this that these those from with into each show tell explain trace does done will have been about how is the are for and why key tables table business rules rule calculation calculate system code file files find give list query check data flow report reporting column columns field fields program programs package packages model models between versus output apply used uses using work works".split()
BASIC_STOP_TERMS = "what where which how is the are for and why from with".split()

#: Headers of the sections of an answer; marks before and a colon after them are optional.
SECTION_HEADERS = {
    "answer": r"ANSWER",
    "key_points": r"KEY POINTS",
    "data_flow": r"DATA FLOW",
    "formula": r"FORMULA(?:S|\s*/\s*CALCULATION)?",
    "sources": r"(?:CONTRIBUTING\s+)?SOURCES",
    "confidence": r"CONFIDENCE(?:\s*&\s*RETRIEVAL\s*INTENT)?",
    "gaps": r"(?:KNOWLEDGE\s+)?GAPS(?:\s*&\s*UNVERIFIED\s*ITEMS)?",
}
#: Extensions of file names in free text.
FILE_NAME = r"[A-Za-z0-9_\-]+\.(?:cbl|cob|cpy|dtsx|sql|xml|py)"

#: What a requested field means, by its name.
CONCEPTS = {
    "schema": "schema",
    "schemas": "schema",
    "table_schema": "schema",
    "db_schema": "schema",
    "schemaname": "schema",
    "table schema": "schema",
    "database": "database",
    "databases": "database",
    "database_name": "database",
    "db": "database",
    "dbname": "database",
    "catalog": "database",
    "catalogs": "database",
    "database name": "database",
    "server": "database",
    "server_name": "database",
    "server name": "database",
    "connection_manager": "database",
    "connection manager": "database",
    "connection": "database",
    "table": "table",
    "tables": "table",
    "table_name": "table",
    "table name": "table",
    "tablename": "table",
    "entity": "table",
    "relation": "table",
    "relations": "table",
    "record_group": "table",
    "record group": "table",
    "columns": "columns",
    "column_list": "columns",
    "columns_list": "columns",
    "fields": "columns",
    "attributes": "columns",
    "cols": "columns",
    "column list": "columns",
    "variables": "columns",
    "column": "column",
    "field": "column",
    "field_name": "column",
    "field name": "column",
    "variable": "column",
    "attribute": "column",
    "col": "column",
    "column_name": "column",
    "column name": "column",
    "alias": "alias",
    "table_alias": "alias",
    "aliases": "alias",
    "table alias": "alias",
    "column_alias": "column_alias",
    "alias_name": "column_alias",
    "column alias": "column_alias",
    "output_column": "column_alias",
    "source_file": "source_file",
    "source file": "source_file",
    "source": "source_file",
    "file": "source_file",
    "filename": "source_file",
    "file_name": "source_file",
    "script": "source_file",
    "sql_file": "source_file",
    "data_type": "data_type",
    "datatype": "data_type",
    "data type": "data_type",
    "type": "data_type",
    "column_type": "data_type",
    "pic": "data_type",
    "picture": "data_type",
    "pic_clause": "data_type",
    "pic clause": "data_type",
    "nullable": "nullable",
    "is_nullable": "nullable",
    "null": "nullable",
    "is nullable": "nullable",
    "join": "joins",
    "joins": "joins",
    "join_condition": "joins",
    "join condition": "joins",
    "relationships": "joins",
    "relationship": "joins",
    "cte": "cte",
    "ctes": "cte",
    "with": "cte",
    "common table expression": "cte",
    "transformation": "transformation",
    "transformations": "transformation",
    "expression": "transformation",
    "expressions": "transformation",
    "formula": "transformation",
    "derived": "transformation",
    "derived_column": "transformation",
    "calculation": "transformation",
    "calculations": "transformation",
    "logic": "transformation",
    "compute": "transformation",
    "rule": "transformation",
    "business_rule": "transformation",
    "business rule": "transformation",
    "rules": "transformation",
    "program": "program",
    "programs": "program",
    "program_id": "program",
    "program id": "program",
    "program_name": "program",
    "program name": "program",
    "cbl_program": "program",
    "cbl": "program",
    "section": "section",
    "sections": "section",
    "division": "section",
    "divisions": "section",
    "section_name": "section",
    "section name": "section",
    "group_level": "group_level",
    "group level": "group_level",
    "level": "group_level",
    "level_number": "group_level",
    "copybook": "copybook",
    "copybooks": "copybook",
    "copy": "copybook",
    "cpy": "copybook",
    "include": "copybook",
    "package": "package",
    "packages": "package",
    "package_name": "package",
    "package name": "package",
    "dtsx": "package",
    "task": "task",
    "tasks": "task",
    "data_flow": "task",
    "data flow": "task",
    "data_flow_task": "task",
    "data flow task": "task",
    "executable": "task",
    "executables": "task",
    "component": "task",
    "component_name": "task",
    "component name": "task",
    "source_table": "source_table",
    "source table": "source_table",
    "source_query": "source_table",
    "destination_table": "destination_table",
    "destination table": "destination_table",
    "target_table": "destination_table",
    "target table": "destination_table",
    "target": "destination_table",
    "destination": "destination_table",
    "column_mapping": "column_mapping",
    "column mapping": "column_mapping",
    "mapping": "column_mapping",
    "mappings": "column_mapping",
}

#: SQL functions that are told apart, and words that are never an alias.
SQL_FUNCTIONS = ("SUM", "COUNT", "AVG", "MIN", "MAX", "CONCAT", "MONTH", "YEAR", "DAY", "GETDATE", "GETUTCDATE", "DATEADD", "DATEDIFF", "CAST", "CONVERT", "COALESCE", "ISNULL", "ROW_NUMBER", "ROUND", "RTRIM", "RIGHT")
NOT_TABLE_ALIASES = ("where", "join", "inner", "left", "right", "full", "cross", "outer", "on", "group", "order", "having", "union", "with", "nolock")
NOT_CASE_ALIASES = ("when", "then", "else", "end", "from", "where", "group", "order", "having", "union", "join", "left", "right", "inner", "full", "cross", "on")
