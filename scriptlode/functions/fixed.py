"""Fixed values. Results depend on these exact words, so they are stated as plain text."""

# A column definition is accepted when its type contains one of these words.
KNOWN_TYPE_WORDS = [
    "varchar", "serial", "long", "uuid", "bytea", "json", "string", "char", "binary", "blob", "clob", "text",
    "enum", "set", "number", "numeric", "bit", "int", "bool", "float", "double", "decimal", "date", "time",
    "year", "image", "real", "identity", "identifier", "raw", "graphic", "money", "geography", "cursor",
    "rowversion", "hierarchyid", "uniqueidentifier", "sql_variant", "xml", "inet", "cidr", "macaddr", "point",
    "line", "lseg", "box", "path", "polygon", "circle", "regproc", "tsvector", "sysname", "tid"]

# SQL type names by family.
BASE_TYPE_FAMILIES = {
    "Numeric": [
        "number", "int", "tinyint", "smallint", "mediumint", "bigint", "integer", "long", "numeric", "float",
        "double", "double precision", "dec", "decimal", "real", "serial", "bigserial", "binary_float",
        "binary_double", "decfloat", "byte", "single", "autonumber"],
    "Boolean": ["bit", "bool", "boolean"],
    "Currency": ["money", "smallmoney", "currency"],
    "String": [
        "char", "varchar", "string", "text", "longtext", "mediumtext", "tinytext", "nchar", "ntext",
        "character", "character varying", "varchar2", "nvarchar2", "graphic", "vargraphic"],
    "Set": ["set"],
    "Binary": [
        "blob", "longblob", "mediumblob", "tinyblob", "binary", "varbinary", "raw", "long raw", "clob",
        "nclob", "dbclob", "bfile"],
    "ID": ["uuid", "identity", "identifier", "uniqueidentifier"],
    "DateTime": [
        "date", "time", "datetime", "datetime2", "smalldatetime", "datetimeoffset", "year", "timestamp",
        "interval", "interval year", "interval day"],
    "Geometric": [
        "point", "line", "lseg", "box", "path", "polygon", "circle", "sdo_geometriy", "sdo_topo_geometry",
        "sdo_georaster"],
    "URI": ["httpuritype", "xdburitype", "dburitype", "hyperlink"],
    "Media": [
        "ordaudio", "orddicom", "orddoc", "ordimage", "ordvideo", "ordimagesignature", "si_averagecolor",
        "si_color", "si_colorhistogram", "si_featurelist", "si_positionalcolor", "si_stillimage", "si_texture"],
    "Enum": ["enum"],
    "sql_variant": ["sql_variant"],
    "XML": ["xml"],
    "Cursor": ["cursor"],
    "Table": ["table"],
    "Image": ["image"],
    "Hierarchyid": ["hierarchyid"],
    "Rawid": ["rawid"],
    "Urowid": ["urowid"],
    "Anytype": ["anytype"],
    "Anydata": ["anydata"],
    "Anydataset": ["anydataset"],
    "Memo": ["memo"],
}

# Aggregate functions recognised in select lists.
AGGREGATES = ("count", "sum", "max", "min", "avg")

# Names of the kept comparison operators, and each name seen from the other side.
OP_NAMES = {"<=": "LtEq", ">=": "GtEq", "<": "Lt", ">": "Gt", "=": "Eq", "==": "Eq"}
MIRRORED = {"LtEq": "GtEq", "GtEq": "LtEq", "Lt": "Gt", "Gt": "Lt", "Eq": "Eq"}

# Words of a condition that name no column.
CONDITION_WORDS = (
    "all", "and", "any", "between", "case", "collate", "current_catalog", "current_date", "current_role",
    "current_schema", "current_time", "current_timestamp", "current_user", "default", "distinct", "else", "end",
    "escape", "exists", "false", "from", "glob", "ilike", "in", "interval", "is", "isnull", "like", "localtime",
    "localtimestamp", "not", "notnull", "null", "on", "or", "regexp", "rlike", "rownum", "select", "session_user",
    "similar", "some", "sysdate", "systimestamp", "system_user", "then", "to", "true", "unknown", "using", "when")

# Statements of this many characters or more are left out of DDL extraction;
# queries are left out above it.
STATEMENT_LIMIT = 50000

# Labels of exported columns.
LABEL_UNIQUE = "[UNIQUE]"
LABEL_NOTNULL = "[NOTNULL]"


def base_type_rows():
    return [(t, family) for family, names in BASE_TYPE_FAMILIES.items() for t in names]
