"""Command text predicates: test-shaped, watch mode, completed test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import DOT, EDGE, NOT_S, S, trimmed

# The command families that count as running tests.
TEST_FAMILIES = (
    f"(npm|pnpm|yarn|bun){S}+(run{S}+)?test(:{NOT_S}+)?{EDGE}",
    f"(pytest|tox|nox){EDGE}",
    f"python[0-9.]*{S}+-m{S}+(pytest|unittest|tox){EDGE}",
    f"go{S}+test{EDGE}",
    f"cargo{S}+test{EDGE}",
    rf"(\./)?(gradle|gradlew)(\.bat)?{S}+{DOT}*{EDGE}test{EDGE}",
    f"mvn{S}+{DOT}*{EDGE}(test|verify){EDGE}",
    f"make{S}+{DOT}*{EDGE}test{EDGE}",
    f"dotnet{S}+test{EDGE}",
    f"ctest{EDGE}",
)
# Watch-mode markers.
WATCH = f"(?i)(--watch{EDGE}|:watch{EDGE}|{EDGE}watch:|--ui{EDGE})"
TEST = "(?i)^(?:" + "|".join(TEST_FAMILIES) + ")"


def is_test_shaped(command: Column) -> Column:
    return trimmed(command).rlike(TEST)


def is_completed_test_shape(command: Column) -> Column:
    return is_test_shaped(command) & ~trimmed(command).rlike(WATCH)


def verdict(exit_code: Column) -> Column:
    """pass, fail, or none when the run produced no numeric exit code."""
    return F.when(exit_code == 0, "pass").when(exit_code.isNotNull(), "fail").otherwise("none")
