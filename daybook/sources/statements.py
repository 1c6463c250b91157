"""Bank statement files: preamble, header hunt, cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.fixed_values import HEADER_SCAN_LINES
from daybook.operators.runs import running_sum
from daybook.schemas import BankProfile
from daybook.session import materialize

# One cell behind its comma: quoted, with doubled quotes inside, or plain.
CELL = r',("[^"]*+(?:""[^"]*+)*"|[^,]*)'


def cells(line: Column) -> Column:
    """Cells of one CSV row, quotes honoured; a quoted cell may hold line breaks."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    found = F.when(line.contains('"'), found).otherwise(F.split(line, ",", -1))
    # A quoted cell ends in its quote, unless it is not closed: then it has no other one.
    closed = lambda c: c.endswith('"') & (F.length(c) > 1)
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - F.when(closed(c), 2).otherwise(1))
    return F.transform(
        found,
        lambda c: F.when(c.startswith('"'), F.replace(inner(c), F.lit('""'), F.lit('"'))).otherwise(c),
    )


def signature(cell_array: Column) -> Column:
    """Sorted, trimmed, lowercased cell texts joined by ``|``; empty cells do not count."""
    names = F.transform(cell_array, lambda c: F.lower(F.trim(c)))
    return F.array_join(F.sort_array(F.filter(names, lambda c: c != "")), "|")


def whole_rows(lines: DataFrame, file: str = "path", order: Sequence[str] = ("block", "line_id", "pos")) -> DataFrame:
    """Rows of CSV files from their lines: a line break inside quotes does not end a row.

    A line with an odd number of quotes, doubled quotes counted twice, opens or closes a quote that
    spans lines. Lines of files without one are rows and are only read. In other files such lines are
    counted per split (the first column of ``order``) and then over splits. A row of one line
    stays where it is; lines of longer rows are brought together by row, stand at their first
    line, and have ``\\n`` between them. A file with an odd number of quotes in all does not
    quote by this rule: its lines stay as they are.
    """
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    turn = F.coalesce(quotes % 2, F.lit(0))
    columns = [file, *order, "line"]
    turning = lines.filter(turn == 1).groupBy(file).agg((F.count(F.lit(1)) % 2).alias("_odd")).filter(F.col(file).isNotNull())
    # Written, so that joins with it are planned by what it holds: few files or none.
    turning = materialize(turning, "quoted-files")
    placed = lines.select(columns).dropna(subset=[file, order[0]])
    if turning.isEmpty():
        return placed
    plain = placed.join(turning, file, "left_anti").select(columns)
    even = lines.join(turning.filter("_odd = 0"), file, "left_semi")
    at = running_sum(even, turn, [file], order[:1], order[1:], "_turns")
    alone = (F.col("_turns") % 2 == 0) & (turn == 0)
    lone = at.filter(alone).select(columns)
    parts = F.sort_array(F.collect_list(F.struct(*order, "line")))
    joined = at.filter(~alone).groupBy(file, F.ceil(F.col("_turns") / 2).alias("_row")).agg(parts.alias("_p"))
    text = F.array_join(F.transform("_p", lambda x: x["line"]), "\n")
    joined = joined.select(file, *[F.col("_p")[0][c].alias(c) for c in order], text.alias("line"))
    odd = lines.join(turning.filter("_odd = 1"), file, "left_semi").select(columns)
    return plain.unionByName(lone).unionByName(joined).unionByName(odd)


def profile_table(lines: DataFrame, profiles: Sequence[BankProfile]) -> DataFrame:
    """The profiles as rows, first one kept per signature."""
    seen: dict[str, BankProfile] = {}
    for p in profiles:
        seen.setdefault(p.signature, p)
    rows = [
        (s, p.name, p.date_col, p.narration_col, p.amount_style, p.amount_col, p.debit_col, p.credit_col)
        for s, p in seen.items()
    ]
    return lines.sparkSession.createDataFrame(
        rows,
        "signature string, profile string, date_col string, narration_col string, "
        "amount_style string, amount_col string, debit_col string, credit_col string",
    )


def _may_be_header(line: Column, signatures: Sequence[str]) -> Column:
    """False only for lines that have none of the signatures: a plain name of one stands in the line as it is."""
    may = F.lit(False)
    for known in signatures:
        names = [n for n in known.split("|") if n and n.isascii() and '"' not in n]
        may = may | (F.lower(line).contains(max(names, key=len)) if names else F.lit(True))
    return may


def find_headers(
    lines: DataFrame,
    profiles: DataFrame,
    file: str = "path",
    order: Sequence[str] = ("block", "line_id", "pos"),
    scan_lines: int | None = HEADER_SCAN_LINES,
) -> DataFrame:
    """Per file the first of its top lines that is a known header: (file, header_at, header, profile...).

    ``scan_lines`` says how far down a header is looked for; None looks at all lines.

    Only lines that may be a header are split into cells. How far down the first header stands is
    a count of the lines before it, so no line is sorted.
    """
    at = F.struct(*order)
    signatures = [r["signature"] for r in profiles.select("signature").collect()]
    heads = (
        lines.filter(_may_be_header(F.col("line"), signatures))
        .withColumn("header", cells(F.col("line")))
        .withColumn("signature", signature(F.col("header")))
        .filter("signature <> ''")
    )
    hits = heads.select(file, "signature", "header", at.alias("header_at"))
    matched = hits.join(profiles, "signature")
    keep = [c for c in matched.columns if c not in (file, "header_at")]
    first = (
        matched.groupBy(file)
        .agg(F.min_by(F.struct("header_at", *keep), "header_at").alias("_h"))
        .select(file, "_h.*")
    )
    # Written: joins with it are planned by its size, and are read more than once.
    first = materialize(first, "statement-headers")
    mark = first.select(F.col(file).alias("_file"), "header_at")
    above = lines.select(file, at.alias("_at")).join(mark, F.col(file).eqNullSafe(F.col("_file")))
    upper = F.count_if(F.col("_at") < F.col("header_at"))
    above = above.filter(F.col("_at") <= F.col("header_at")).groupBy("_file").agg(upper.alias("_above"), F.count(F.lit(1)).alias("_upto"))
    found = first.join(above, F.col(file).eqNullSafe(F.col("_file")))
    # Of lines that share the place of the header it is the last.
    row = F.col("_upto") - 1
    if scan_lines is not None:
        found, row = found.filter(F.col("_above") < scan_lines), F.least(row, F.lit(scan_lines - 1))
    found = found.withColumn("header_row", row.cast("int"))
    return found.select(*first.columns, "header_row")


def statement_cells(
    lines: DataFrame,
    profiles: Sequence[BankProfile],
    file: str = "path",
    order: Sequence[str] = ("block", "line_id", "pos"),
    scan_lines: int | None = HEADER_SCAN_LINES,
) -> DataFrame:
    """Data lines of every statement as texts by role, files of all banks in one job.

    Columns sit where the file's own header puts them. Files without a known header give no
    rows. Quoted cells may hold line breaks, see ``whole_rows``.
    """
    lines = whole_rows(lines, file, order)
    headers = find_headers(lines, profile_table(lines, profiles), file, order, scan_lines)
    names = F.transform("header", lambda h: F.trim(h))
    roles = ("date", "narration", "amount", "debit", "credit")
    places = [F.array_position(names, F.trim(f"{role}_col")).cast("int").alias(f"_{role}") for role in roles]
    # Written: one row per file, and the lines meet it without counting again.
    headers = materialize(headers.select(file, "header_at", "profile", "amount_style", *places), "statement-columns")
    rows = lines.join(headers, file).filter(F.struct(*order) > F.col("header_at"))
    rows = rows.withColumn("_c", cells(F.col("line")))

    def cell(role: str) -> Column:
        at = F.col(f"_{role}")
        return F.when(at > 0, F.get("_c", at - 1)).alias(f"{role}_text")

    return rows.select(file, *order, "profile", "amount_style", *[cell(role) for role in roles])
