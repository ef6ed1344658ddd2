"""What commit subjects say: kinds, pull requests, tickets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of commit conventions and of pull request merges.
FIX_TYPE = r"(?i)^(fix|hotfix|bugfix|revert)(\(.+\))?!?:"
CONVENTION = r"(?i)^(feat|docs|style|refactor|perf|tests?|build|ci|chore)(\(.+\))?!?:"
REVERT = r'^Revert "'
FIX_WORDS = ("fix", "fixes", "fixed", "fixing", "bug", "bugfix", "hotfix")
SCOPED_FIX = r"^[a-z][a-z0-9._/-]*:\s*(fix|fixes|fixed)\b"
BUG_TICKET = r"(?i)^bug[\s#-]*\d"
PULL_REQUEST = r"\(#(\d+)\)\s*$"
SQUASHED = r"^(Merged PR \d+:|Pull request #\d+:)"
TICKET = r"(?<![A-Za-z0-9])([A-Z][A-Z0-9]+)-\d+(?![A-Za-z0-9])"
NOT_TICKETS = (
    "AES BSD CVE CWE ECMA ES GHSA GPL GPT HTTP HTTPS IE IEC IEEE IPV ISO LGPL MD MIT PEP RFC RSA SHA SSH SSL TCP TLS UCS UDP UTF WCAG X64 X86"
).split()
MERGES = (
    r"(?m)^Merge pull request (?:#\d+ |.* \(#\d+\) )from ",
    r"(?m)^Merge pull request #\d+ in \S+ from ",
    r"(?m)^Pull request #\d+: ",
    r"(?m)^Merged in .* \(pull request #\d+\)",
    r"(?m)^See merge request \S*!\d+",
    r"(?m)^Merged PR \d+:",
)
BRANCHES = (
    r"(?m)^Merge pull request #\d+ from [^/\s]+/(\S+)",
    r"(?m)^Merge pull request '.*' \(#\d+\) from (\S+) into ",
    r"(?m)^Merged in (\S+) \(pull request #",
    r"(?m)^Merge (?:pull request #\d+ )?in \S+ from (\S+) to ",
    r"(?m)^Merge branch '([^']+)' into ",
)
INTEGRATION = r"(?i)^(?:(?:main|master|trunk|develop|development|dev|staging|stable|next|integration)|(?:releases?|stable)(?:[/_-].*)?)$"


def subject_kind(subject: Column) -> Column:
    """fix, convention or other; a null subject is other."""
    first = F.lower(F.regexp_extract(subject, r"(?i)^[a-z]+", 0))
    word = first.isin(*FIX_WORDS) & ~subject.rlike(BUG_TICKET)
    fix = subject.rlike(FIX_TYPE) | subject.rlike(REVERT) | word | (subject.rlike(SCOPED_FIX) & ~subject.rlike(CONVENTION))
    return F.when(fix, "fix").when(subject.rlike(CONVENTION), "convention").otherwise("other")


def majority_kind(kind: Column) -> Column:
    """Aggregate over a change's commits: what more than half of them are, fixes following a convention too."""
    fixes, conventional = F.count_if(kind == "fix"), F.count_if(kind != "other")
    return F.when(fixes * 2 > F.count(kind), "fix").when(conventional * 2 > F.count(kind), "convention").otherwise("other")


def pull_request_of(subject: Column) -> Column:
    """Number of the pull request that a subject ends with, else null."""
    return F.nullif(F.regexp_extract(subject, PULL_REQUEST, 1), F.lit(""))


def is_squashed(subject: Column) -> Column:
    return subject.rlike(PULL_REQUEST) | subject.rlike(SQUASHED)


def ticket_of(subject: Column) -> Column:
    """First ticket key of a subject, words such as ``UTF-8`` left out; else null."""
    keys = F.regexp_extract_all(subject, F.lit(TICKET), F.lit(0))
    real = F.filter(keys, lambda k: ~F.regexp_extract(k, r"^(.*)-\d+$", 1).isin(NOT_TICKETS))
    return F.get(real, 0)


def merge_kind(message: Column) -> Column:
    """branch or integration for the merge of a pull request, else null."""
    names = F.lit(False)
    for pattern in MERGES:
        names = names | message.rlike(pattern)
    branch = F.coalesce(*[F.nullif(F.regexp_extract(message, pattern, 1), F.lit("")) for pattern in BRANCHES])
    return F.when(names, F.when(branch.rlike(INTEGRATION), "integration").otherwise("branch"))
