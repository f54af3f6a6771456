"""Chat formatting whose output parses back to the turns it was made of.

A turn is written as `### Role:`, a line feed, the text, a line feed, `</turn>` and a line feed. A deterministic
parser cuts at the closing line and takes one backslash away wherever backslashes stand before `###` or
`</turn>`. A text that holds `###` or `</turn>` anywhere is written with one backslash more before each such
string, and so is a turn that written verbatim does not parse back; the whole is parsed and compared again. The
two agree then for any text: the escape puts a backslash before every opener, so no text can close its turn.
Roles other than user, assistant and system are written after `@`, with backslash, colon and line feed escaped.

Null text or role: empty. Turns of equal number are ordered by role, then text; repeated rows are turns of
their own; a null turn number comes first; rows of null conv_id form one conversation. Extra columns are
not read. An empty table gives no conversation. A conversation becomes one string, so it must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD, CLOSE = "### ", "</turn>"
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
GUARDED = r"(\\*)(###|</turn>)"
ESCAPED = r"\\(\\*)(###|</turn>)"
END = f"\n{CLOSE}\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, GUARDED, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def role_name(role: Column) -> Column:
    out = F.concat(F.lit("@"), F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n")))
    for k, v in ROLES.items():
        out = F.when(role == k, F.lit(v)).otherwise(out)
    return out


def role_of(name: Column) -> Column:
    plain = F.substring(name, 2, 1 << 30)
    out = F.when(F.contains(plain, F.lit("\\")), F.replace(F.replace(F.replace(F.replace(plain, F.lit("\\\\"), F.lit("\\b")), F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))).otherwise(plain)
    for k, v in ROLES.items():
        out = F.when(name == v, F.lit(k)).otherwise(out)
    return out


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), role_name(role), F.lit(":\n"), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation: role, text, at (code points before the body), size (of the body)."""
    pieces = F.split(formatted, r"\n</turn>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    head = lambda p: F.instr(p, ":\n")
    parts = F.transform(
        pieces,
        lambda p: F.struct(
            role_of(F.substring(p, F.lit(len(HEAD) + 1), head(p) - 1 - len(HEAD))).alias("role"),
            F.substring(p, head(p) + 2, F.char_length(p)).alias("body"),
            (head(p) + 1).alias("skip"),
        ),
    )
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<role:string,text:string,at:bigint,size:bigint>>").alias("done"))
    add = lambda acc, p: F.struct(
        (acc["at"] + p["skip"] + F.char_length(p["body"]) + len(END)).alias("at"),
        F.concat(acc["done"], F.array(F.struct(p["role"].alias("role"), unescape(p["body"]).alias("text"), (acc["at"] + p["skip"]).alias("at"), F.char_length(p["body"]).cast("bigint").alias("size")))).alias("done"),
    )
    return F.aggregate(parts, begin, add, lambda acc: acc["done"])


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, formatted, n_escaped (turns written so), and loss_spans: (at, size) in code points of each
    assistant body in `formatted`."""
    own = rows.select(F.col(conv).alias("c"), F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    plain = own.withColumn("plain", render(F.col("r"), F.col("t"))).withColumn("back", parse(F.col("plain")))
    same = (F.size("back") == 1) & (F.get("back", F.lit(0))["role"] == F.col("r")) & (F.get("back", F.lit(0))["text"] == F.col("t"))
    escaped = F.col("t").rlike(GUARDED) | ~same
    turns = plain.withColumn("escaped", escaped).select("c", "n", "r", "t", F.when(F.col("escaped"), render(F.col("r"), escape(F.col("t")))).otherwise(F.col("plain")).alias("out"), "escaped")
    ordered = turns.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "r", "t", "out", "escaped"))).alias("x"))
    out = ordered.select("c", "x", F.concat_ws("", F.col("x.out")).alias("formatted")).withColumn("turns", parse(F.col("formatted")))
    source, got = F.transform("x", lambda a: F.struct(a["r"].alias("role"), a["t"].alias("text"))), F.transform("turns", lambda a: F.struct(a["role"].alias("role"), a["text"].alias("text")))
    checked = F.when(source == got, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation does not parse back: "), F.coalesce(F.col("c").cast("string"), F.lit("null")))))
    spans = F.transform(F.filter("turns", lambda a: a["role"] == "assistant"), lambda a: F.struct(a["at"].alias("at"), a["size"].alias("size")))
    return out.select(F.col("c").alias(conv), checked.alias("formatted"), F.size(F.filter("x", lambda a: a["escaped"])).alias("n_escaped"), spans.alias("loss_spans"))


def under_mask(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped span by span."""
    cut = F.transform(spans, lambda s: unescape(F.substring(F.col(formatted), (s["at"] + 1).cast("int"), s["size"].cast("int"))))
    return F.concat_ws("", cut)
