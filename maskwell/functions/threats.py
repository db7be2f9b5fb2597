"""Hostile-content patterns and the Column that reports them.

Each pattern states which capture group is the reported value and which plain words a
text must hold to have a match at all; without those words the regex is not run. Patterns
with an open-ended middle have a second alternative that swallows the rest of the text:
when their first start fails, every later one does too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.text import SPACE as S
from maskwell.functions.text import WORD, contains_any, fold_case, let

FLAGS = "(?ius)"


@dataclass(frozen=True)
class ThreatPattern:
    pattern: str
    group: int
    needs: tuple[str, ...]


# --- fixed values --------------------------------------------------------------------
# Threat names, patterns and their order must stay as they are for results to agree with
# existing data.
THREATS = {
    "sql_injection": (
        ThreatPattern(
            rf"(DROP[{S}]+TABLE|DROP[{S}]+DATABASE|TRUNCATE[{S}]+TABLE)", 1, ("drop", "truncate")
        ),
        ThreatPattern(
            rf"(DELETE[{S}]+FROM[{S}]+[{WORD}]+[{S}]+WHERE[{S}]+1[{S}]*=[{S}]*1)", 1, ("delete",)
        ),
        ThreatPattern(
            rf"(INSERT[{S}]+INTO.*SELECT[{S}]+\*)|INSERT[{S}]+INTO.*+", 1, ("insert",)
        ),
        ThreatPattern(rf"(UNION[{S}]+SELECT.*FROM)|UNION[{S}]+SELECT.*+", 1, ("union",)),
        ThreatPattern(
            rf"(xp_cmdshell|exec[{S}]*\(|execute[{S}]*\()", 1, ("xp_cmdshell", "exec")
        ),
        ThreatPattern(
            rf"(;[{S}]*DROP|;[{S}]*DELETE|;[{S}]*TRUNCATE|;[{S}]*ALTER)",
            1,
            ("drop", "delete", "truncate", "alter"),
        ),
    ),
    "xss": (
        ThreatPattern(r"(<script[^>]*>.*?</script>)|<script.*+", 1, ("<script",)),
        ThreatPattern(rf"javascript[{S}]*:", 0, ("javascript",)),
        ThreatPattern(
            rf"on(load|click|mouseover|error|focus)[{S}]*=",
            1,
            ("onload", "onclick", "onmouseover", "onerror", "onfocus"),
        ),
        ThreatPattern(r"(<iframe[^>]*>)|<iframe.*+", 1, ("<iframe",)),
        ThreatPattern(r"document\.cookie", 0, ("document.cookie",)),
        ThreatPattern(r"window\.location", 0, ("window.location",)),
    ),
    "shell_commands": (
        ThreatPattern(rf"(rm[{S}]+-rf|rmdir[{S}]+/s)", 1, ("-rf", "rmdir")),
        ThreatPattern(rf"(wget|curl)[{S}]+https?://", 1, ("wget", "curl")),
        ThreatPattern(rf"(bash|sh|cmd|powershell)[{S}]+-c", 1, ("-c",)),
        ThreatPattern(
            rf"(__import__[{S}]*\([{S}]*['\"]os['\"]|subprocess\.call|os\.system)",
            1,
            ("__import__", "subprocess.call", "os.system"),
        ),
        ThreatPattern(rf"(eval[{S}]*\(|exec[{S}]*\()", 1, ("eval", "exec")),
        ThreatPattern(r"/etc/passwd|/etc/shadow", 0, ("/etc/passwd", "/etc/shadow")),
    ),
    "path_traversal": (
        ThreatPattern(r"\.\./\.\./", 0, ("../../",)),
        ThreatPattern(r"%2e%2e%2f", 0, ("%2e%2e%2f",)),
        ThreatPattern(r"\.\.\\", 0, ("..\\",)),
    ),
}
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")
# --- end of fixed values ---------------------------------------------------------------

THREAT_TYPES = tuple(THREATS)


def _found(p: ThreatPattern, text: Column, folded: Column, kept: int | None) -> Column:
    hits = F.regexp_extract_all(text, F.lit(FLAGS + p.pattern), F.lit(p.group))
    if "|" in p.pattern and p.pattern.endswith(".*+"):
        hits = F.filter(hits, lambda h: h != "")
    nothing = F.array().cast("array<string>")
    if kept is not None:
        hits = F.slice(hits, 1, kept)
    return F.when(contains_any(folded, p.needs), hits).otherwise(nothing)


def threat_details(text: Column, folded: Column, kept: int | None = None) -> Column:
    """Map of threat type to its reported values; types without any are absent."""
    pairs = []
    for name, patterns in THREATS.items():
        pairs += [F.lit(name), F.concat(*[_found(p, text, folded, kept) for p in patterns])]
    return F.map_filter(F.create_map(*pairs), lambda k, v: F.size(v) > 0)


def malicious_content(text: Column, extension: Column, kept: int | None = None) -> Column:
    """Struct of ``safe``, ``threats`` and ``details``; images are always safe.

    All hits are reported, or the first ``kept`` of each pattern.
    """
    nothing = F.create_map().cast("map<string,array<string>>")

    def scan(t: Column) -> Column:
        return let(fold_case(t), lambda folded: threat_details(t, folded, kept))

    details = F.when(
        extension.isin(*IMAGE_EXTENSIONS) | text.isNull(), nothing
    ).otherwise(let(text, scan))
    return let(
        details,
        lambda d: F.struct(
            (F.size(F.map_keys(d)) == 0).alias("safe"),
            F.map_keys(d).alias("threats"),
            d.alias("details"),
        ),
    )
