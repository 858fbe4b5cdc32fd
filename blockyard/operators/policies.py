"""Label policies: ordered definitions that change a region's final type, by the region and its neighbours on the page.

Policies are Columns, so a user may put one before another, replace it or leave it out by name; ``POLICIES`` has the usual ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How headings of related and of trending sections begin.
RELATED = r"(?iu)^(related|read more|you may also like|you might also like|recommended( for you)?|see also|more (from|on|like) |also (in|on) |further reading|more stories|explore more|next up|up next|discover more|you.ll also love|most-saved)"
TRENDING = r"(?iu)^(most (read|popular|viewed|shared|watched|commented)|trending|popular|top (stories|picks|rated)|hot network|editor.?s picks|best ?sellers?)"

#: A condition is given the names of columns as of the region before and after; these are null at the ends of a page.
Neighbour = Callable[[str], Column]


@dataclass(frozen=True)
class Policy:
    """Regions for which ``holds(before, after)`` is true get ``kind``, a type's name or a Column."""

    name: str
    kind: str | Column
    holds: Callable[[Neighbour, Neighbour], Column]


@dataclass(frozen=True)
class PolicySet:
    """Policies in order, each name once."""

    policies: tuple[Policy, ...] = ()

    def add(self, policy: Policy, before: str | None = None) -> PolicySet:
        """With ``policy`` before the one of that name, else at the end; one of its own name is replaced where it is."""
        names = self.names()
        if policy.name in names:
            if before is not None:
                return self.without(policy.name).add(policy, before)
            return PolicySet(tuple(policy if p.name == policy.name else p for p in self.policies))
        if before is not None and before not in names:
            raise KeyError(f"no policy named {before}")
        at = names.index(before) if before is not None else len(names)
        return PolicySet((*self.policies[:at], policy, *self.policies[at:]))

    def without(self, name: str) -> PolicySet:
        return PolicySet(tuple(p for p in self.policies if p.name != name))

    def names(self) -> list[str]:
        return [p.name for p in self.policies]

    def apply(self, labels: DataFrame) -> DataFrame:
        """Changes final and adds policy, the name of what changed it, else null.

        The first policy that holds and gives another type than final wins; conditions see the finals from before. Rows are
        ordered by idx within a page_id and may have any other columns.
        """
        page = Window.partitionBy("page_id").orderBy("idx")
        before, after = (lambda c: F.lag(c).over(page)), (lambda c: F.lead(c).over(page))
        hits = []
        for p in self.policies:
            kind = F.lit(p.kind) if isinstance(p.kind, str) else p.kind
            hits.append(F.when(p.holds(before, after) & kind.isNotNull() & ~kind.eqNullSafe(F.col("final")), F.struct(kind.alias("kind"), F.lit(p.name).alias("name"))))
        nothing = F.lit(None).cast("struct<kind:string,name:string>")
        told = labels.withColumn("_policy", F.coalesce(*hits, nothing))
        return told.withColumns({"policy": F.col("_policy.name"), "final": F.coalesce("_policy.kind", "final")}).drop("_policy")


def short(text_length: Column) -> Column:
    return text_length < 40


def _cards_under(heading: str) -> Callable[[Neighbour, Neighbour], Column]:
    return lambda before, after: (F.col("final") == "teaser_card") & short(before("text_length")) & F.coalesce(before("text"), F.lit("")).rlike(heading)


#: A short heading stays a heading; cards right after a short heading that names related or trending content take its type.
POLICIES = PolicySet((
    Policy("heading-is-heading", "heading", lambda before, after: F.col("tag").rlike("^h[1-6]$") & short(F.col("text_length")) & F.col("final").isin("related", "trending")),
    Policy("related-slot", "related", _cards_under(RELATED)),
    Policy("trending-slot", "trending", _cards_under(TRENDING)),
))


def apply_policies(labels: DataFrame, policies: PolicySet = POLICIES) -> DataFrame:
    """Changes final by the label policies and adds the policy's name; rows carry tag, text and text_length of their region."""
    return policies.apply(labels)
