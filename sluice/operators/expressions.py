"""Safe config expressions (T5): an allow-list over the parsed expression.

Config text is untrusted. It is parsed by Spark's own parser, and every node
of the tree must be a known operator or a call of a listed function, so
quoting, comments and letter case change nothing. Subqueries, windows, stars,
generators, reflection, randomness, time and session functions are not on the
list; names that Spark would resolve as such functions without brackets are
rejected unless they are columns.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

# Operators and literals of the parsed tree.
NODES = frozenset("""
Literal UnresolvedAttribute UnresolvedExtractValue Cast Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus
UnaryPositive And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In Like LikeAll LikeAny
NotLikeAll NotLikeAny RLike ILike IsNull IsNotNull CaseWhen Concat BitwiseAnd BitwiseOr BitwiseXor BitwiseNot StringTrim
StringTrimLeft StringTrimRight StringLocate Substring Overlay CreateNamedStruct LambdaFunction UnresolvedNamedLambdaVariable
""".split())
# Deterministic functions of their arguments.
FUNCTIONS = frozenset("""
abs ceil ceiling floor round bround sign signum sqrt cbrt pow power exp ln log log2 log10 mod pmod greatest least isnan nanvl
try_add try_subtract try_multiply try_divide try_mod div negative positive width_bucket bin hex unhex conv
coalesce nvl nvl2 ifnull nullif if iff isnull isnotnull between equal_null nullifzero zeroifnull case
upper lower ucase lcase initcap trim ltrim rtrim btrim length char_length character_length octet_length bit_length concat concat_ws
substring substr left right replace translate repeat reverse lpad rpad instr locate position split split_part contains startswith
endswith regexp_extract regexp_extract_all regexp_replace regexp_like regexp_count regexp_instr rlike like ilike ascii chr char
format_number format_string printf levenshtein soundex base64 unbase64 encode decode md5 sha sha1 sha2 crc32 hash xxhash64
cast string int integer bigint long smallint tinyint double float real decimal boolean date timestamp binary
to_number try_to_number to_char to_date to_timestamp try_to_date try_to_timestamp unix_timestamp to_unix_timestamp from_unixtime
date_format date_add date_sub datediff date_diff date_trunc trunc add_months months_between last_day next_day make_date
make_timestamp year month day dayofmonth dayofweek dayofyear weekday weekofyear quarter hour minute second extract date_part
unix_date unix_millis unix_micros unix_seconds timestamp_millis timestamp_micros timestamp_seconds from_utc_timestamp to_utc_timestamp
array array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove
array_size array_sort array_union cardinality element_at exists filter forall aggregate reduce flatten get size slice sort_array
transform try_element_at zip_with map map_keys map_values map_contains_key named_struct struct any some every
get_json_object json_array_length json_object_keys to_json parse_json try_parse_json variant_get try_variant_get is_variant_null
typeof try_cast
""".split())
# Names that stand for a function without brackets.
BARE = frozenset("current_date current_timestamp current_time localtimestamp now current_user user session_user current_catalog "
                 "current_database current_schema current_timezone curdate grouping__id input_file_name".split())
# Calls that read the clock when they have no argument.
NEEDS_ARGUMENT = frozenset({"unix_timestamp", "to_unix_timestamp"})


def check_expression(text: str, columns: Sequence[str] = ()) -> str:
    """Return the text if every part of it is allowed; else raise ValueError."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except ParseException as e:
        raise ValueError(f"not an expression: {text!r}") from e
    names = {c.lower() for c in columns}
    todo = [tree]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind == "UnresolvedFunction":
            name = node.nameParts().mkString(".").lower()
            if name not in FUNCTIONS:
                raise ValueError(f"expression may not call {name}(): {text!r}")
            if name in NEEDS_ARGUMENT and node.children().isEmpty():
                raise ValueError(f"{name}() without an argument reads the clock: {text!r}")
        elif kind not in NODES:
            raise ValueError(f"expression may not hold a {kind}: {text!r}")
        elif kind == "UnresolvedAttribute":
            name = node.nameParts().mkString(".").lower()
            if name in BARE and name not in names:
                raise ValueError(f"expression may not use {name}: {text!r}")
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return text
