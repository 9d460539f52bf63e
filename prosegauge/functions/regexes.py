"""Rules' regular expressions, brought from linear-time syntax to the JVM's.

Rules are written for an engine with Unicode classes, ``.`` that excludes the line
feed alone, and anchors that see the line feed alone. In the JVM that is the flags
U and d. A counted group at the end of an expression is rewritten so that it does
not recurse: once the least count is met nothing follows, so the rest may be
possessive.
"""

from __future__ import annotations

import re

FLAGS = re.compile(r"^\(\?([a-zA-Z]+)\)")
FOREIGN = re.compile(r"\(\?[=!>]|\(\?<[=!]|\\[1-9]|\\k<")
COUNTED = re.compile(r"\)\{(\d+),\}$")


def group_start(regex: str, end: int) -> int:
    """Where the group opens that closes at ``end``."""
    opens, escaped, in_class = [], False, False
    for k, c in enumerate(regex[: end + 1]):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            opens.append(k)
        elif c == ")":
            at = opens.pop()
            if k == end:
                return at
    raise ValueError(f"unbalanced group: {regex}")


def end_anchors(regex: str) -> str:
    """``$`` as the end of the text alone, which the JVM would also see before a last line feed."""
    out, escaped, in_class = [], False, False
    for c in regex:
        if not escaped and not in_class and c == "$":
            out.append(r"\z")
            continue
        in_class = c == "[" if not in_class and not escaped else in_class and (escaped or c != "]")
        escaped = not escaped and c == "\\"
        out.append(c)
    return "".join(out)


def to_java(regex: str) -> str:
    """The JVM's spelling; ValueError for what a linear-time engine has not got."""
    if FOREIGN.search(regex):
        raise ValueError(f"look-around and back-references are not supported: {regex}")
    flags, body = "", regex
    while m := FLAGS.match(body):
        flags, body = flags + m[1], body[m.end() :]
    if set(flags) - set("imsxu"):
        raise ValueError(f"unsupported flags: {regex}")
    body = body.replace("(?P<", "(?<")
    if "m" not in flags:
        body = end_anchors(body)
    if m := COUNTED.search(body):
        at = group_start(body, m.start())
        group = body[at : m.start() + 1]
        body = f"{body[:at]}{group}{{{m[1]}}}{group}*+"
    return "(?Ud" + "".join(f for f in "imsx" if f in flags) + ")" + body


def compiles(regex: str) -> bool:
    """Whether the JVM takes it; without a session, whether it can be translated."""
    from pyspark.sql import SparkSession

    try:
        java = to_java(regex)
    except (ValueError, IndexError):
        return False
    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, PySparkException):  # PySpark translates the exceptions that it knows
        return False
    return True
