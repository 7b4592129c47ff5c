"""Textual headers: 40 lines of 80 characters, as column functions on strings and arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINES, WIDTH = 40, 80
TITLE = "***** PROCESSING WORKFLOW *****"


def wrap(text: Column, width: int = WIDTH) -> Column:
    """Fixed-width pieces as an array."""
    n = F.greatest(F.ceil(F.length(text) / width), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * width + 1, F.lit(width)))


def blank_positions(s: Column) -> Column:
    """Numbers, from 0, of the blanks."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0))), lambda i: F.when(F.substring(s, i + 1, F.lit(1)) == " ", i)), lambda i: i.isNotNull())


def _found(lines: Column, test) -> Column:
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def empty_line(lines: Column) -> Column:
    """Number, from 0, of the first line with nothing but blanks after its three-character prefix; null if there is none."""
    return F.get(_found(lines, lambda x: F.trim(F.substring(x, F.lit(4), F.lit(WIDTH))) == ""), F.lit(0))


def lines_starting(lines: Column, text: str) -> Column:
    """Numbers of the lines that start with the text behind their prefix and a blank or none."""
    return _found(lines, lambda x: F.startswith(F.ltrim(F.substring(x, F.lit(4), F.lit(WIDTH))), F.lit(text)))


def line_with(lines: Column, text: str) -> Column:
    """Number of the first line that contains the text."""
    return F.get(_found(lines, lambda x: F.contains(x, F.lit(text))), F.lit(0))


def fitted(line: Column, width: int = WIDTH) -> Column:
    """Cut or filled with blanks to the width."""
    return F.rpad(line, width, " ")


def prefixed(i: int, body: str = "") -> str:
    return f"C{i:2d}{body}".ljust(WIDTH)[:WIDTH]


def set_line(lines: Column, number: Column | int, text: Column) -> Column:
    """Line `number` (from 0) with its prefix kept and the text behind it."""
    return F.transform(lines, lambda x, i: F.when(i == number, fitted(F.concat(F.substring(x, F.lit(1), F.lit(3)), text))).otherwise(x))


def set_title(lines: Column, title: str = TITLE, line: int = 25) -> Column:
    """The title centred in a line (from 1), blank lines behind it up to the 39th."""
    room = WIDTH - 3
    centred = title.center(room)[:room]
    return F.transform(
        lines,
        lambda x, i: F.when(i == line - 1, fitted(F.concat(F.substring(x, F.lit(1), F.lit(3)), F.lit(centred)))).when((i >= line) & (i < LINES - 1), fitted(F.substring(x, F.lit(1), F.lit(3)))).otherwise(x),
    )


def add_info(lines: Column, info: str, prefix: str, line: int = 25) -> Column:
    """Appends info, after two blanks, to the first line behind the title that starts with `prefix:` and has room, else writes ` prefix: info` to the first empty line there.

    A header without room raises an error where it is written: it is never lost.
    """
    used = lambda x: F.rtrim(x)
    room = lambda i: (i >= line) & (F.length(used(F.get(lines, i))) + 2 + len(info) <= WIDTH)
    own = F.get(F.filter(lines_starting(lines, f"{prefix}:"), room), F.lit(0))
    fits = own.isNotNull()
    empty = F.get(F.filter(_found(lines, lambda x: F.trim(F.substring(x, F.lit(4), F.lit(WIDTH))) == ""), lambda i: i >= line), F.lit(0))
    appended = F.transform(lines, lambda x, i: F.when(i == own, fitted(F.concat(used(x), F.lit("  " + info)))).otherwise(x))
    full = F.raise_error(F.lit("the textual header is full")).cast("array<string>")
    return F.when(lines.isNull(), lines).when(fits, appended).when(empty.isNotNull(), set_line(lines, empty, F.lit(f" {prefix}: {info}"))).otherwise(full)


def is_ascii(text: Column) -> Column:
    return ~text.rlike("[^\\x00-\\x7F]")


def is_valid(text: Column) -> Column:
    return F.octet_length(text) == LINES * WIDTH


def history(lines: Column) -> Column:
    """Lines that start with an ISO date and a colon behind their prefix."""
    return F.filter(lines, lambda x: F.ltrim(F.substring(x, F.lit(4), F.lit(WIDTH))).rlike("^\\d{4}-\\d{2}-\\d{2}:"))


def without_colours(text: Column) -> Column:
    """Log text without ANSI escapes."""
    return F.regexp_replace(text, "\\x1b\\[[0-9;]*[A-Za-z]", "")


def line_of_file(path: Column, splitter: str = "UTM") -> Column:
    """The name's parts before the first that contains the splitter, joined by _; the whole stem without one."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    parts = F.split(stem, "_")
    at = F.array_position(F.transform(parts, lambda p: F.contains(p, F.lit(splitter))), F.lit(True))
    return F.when(at == 0, stem).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))), "_"))


def renamed_interval(name: Column, interval: str) -> Column:
    """A file name with its sampling interval (digits, +, digits, ms) replaced."""
    return F.regexp_replace(name, "\\d{1,2}\\+\\d{0,3}(ms)", interval + "$1")


def coordinate_text(x: Column, units: int) -> Column:
    """%.2f for lengths, %.6f for degrees."""
    return F.format_string("%.2f" if units == 1 else "%.6f", x.cast("double"))
