"""Predicates of framing and graph reads, as plain columns that Spark pushes to the scan where it can."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CREATED, UPDATED, DELETED = 0, 1, 2


def matches(text: str, pattern: str) -> Column:
    """Case-insensitive search for a regular expression anywhere in a column."""
    return F.col(text).rlike("(?i)" + pattern)


def flags(column: str, mask: int, how: str) -> Column:
    """Bit tests: all_set, any_set, all_clear or any_clear of the bits of mask."""
    bits = F.col(column).bitwiseAND(F.lit(mask))
    tests = {"all_set": bits == mask, "any_set": bits != 0, "all_clear": bits == 0, "any_clear": bits != mask}
    return tests[how]


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def part_key(key: str, black: bool = False) -> Column:
    """typeId[:roleId]. A white key without role asks for a part without role; a black key looks at the type only."""
    type_id, _, role = key.partition(":")
    if black:
        return F.col("typeId") == type_id
    return (F.col("typeId") == type_id) & (F.col("roleId") == role if role else F.col("roleId").isNull())


def part_types(white: Sequence[str] = (), black: Sequence[str] = ()) -> Column:
    """Any of the white keys, if there are some, and none of the black ones."""
    tests = []
    if white:
        tests.append(any_of([part_key(k) for k in white]))
    if black:
        tests.append(~F.coalesce(any_of([part_key(k, True) for k in black]), F.lit(False)))
    return all_of(tests)


@dataclass(frozen=True)
class FrameFilter:
    """What a frame holds. min_time asks for an incremental frame; max_time alone for a snapshot as of then."""

    title: str | None = None
    description: str | None = None
    facet_id: str | None = None
    group_id: str | None = None
    user_id: str | None = None
    flags: int | None = None
    flag_match: str = "all_set"
    min_time: str | None = None
    max_time: str | None = None
    white_types: tuple[str, ...] = field(default=())
    black_types: tuple[str, ...] = field(default=())
    page: int | None = None
    page_size: int = 20

    @property
    def is_empty(self) -> bool:
        return self == FrameFilter(page=self.page, page_size=self.page_size)

    def attributes(self) -> Column:
        """The conjunction of the tests on an item; true if there are none."""
        tests = []
        if self.title:
            tests.append(matches("title", self.title))
        if self.description:
            tests.append(matches("description", self.description))
        tests += [F.col(c) == v for c, v in (("facetId", self.facet_id), ("groupId", self.group_id), ("userId", self.user_id)) if v]
        if self.flags is not None:
            tests.append(flags("flags", self.flags, self.flag_match))
        return all_of(tests)

    def _stamp(self, value: str) -> Column:
        return F.lit(value).cast("timestamp_ntz")

    def until(self, incremental: bool) -> Column:
        """The time test: a closed interval in an incremental frame, else only the upper bound."""
        tests = []
        if incremental and self.min_time:
            tests.append(F.col("timeModified") >= self._stamp(self.min_time))
        if self.max_time:
            tests.append(F.col("timeModified") <= self._stamp(self.max_time))
        return all_of(tests)
