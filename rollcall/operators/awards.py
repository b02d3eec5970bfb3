"""Threshold awards per person and period (awards 1-14), from one roll-up of the posts.

The source computes each award with its own filter + group-by over the post
fact (ten passes). Here every award is a row of the ``AwardSpec`` table and
all the counters come from one scan and one aggregate of the fact: the posts are
counted per (person, site, day, class flags), with map-side partial
aggregation, and only these narrow rows are clustered by person. Year, month,
week, per-site and distinct-site counters are then rolled up from them where they
lie. A hot person is split over all tasks by the first aggregate, and
after it has at most one row a site, day and class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.constants import AWARD_CATALOGUE, AWARD_RULES
from rollcall.functions.classify import is_qsource, is_workout

AWARD_COLUMNS = ("achievement_id", "period_kind", "period", "email", "region", "date_awarded")


@dataclass(frozen=True)
class AwardSpec:
    id: int
    code: str
    period: str  # year | month | week | year_ao
    event_class: str  # qsource | workout
    leaders_only: bool
    measure: str  # posts | sites
    threshold: int

    @property
    def period_kind(self) -> str:
        """Period reported with the award (per-site awards are yearly)."""
        return "year" if self.period == "year_ao" else self.period

    @property
    def counter(self) -> str:
        """Name of the per-group counter this award is measured on."""
        if self.event_class == "qsource":
            return "qs"
        return "wq" if self.leaders_only else "w"


def _build_defaults() -> tuple[AwardSpec, ...]:
    specs = []
    for (aid, period, cls, leaders, measure, threshold), (*_text, code) in zip(AWARD_RULES, AWARD_CATALOGUE):
        specs.append(AwardSpec(aid, code, period, cls, leaders, measure, threshold))
    return tuple(specs)


DEFAULT_AWARDS: tuple[AwardSpec, ...] = _build_defaults()


def award_specs(thresholds: dict[int | str, int] | None = None, ids: Iterable[int] | None = None) -> tuple[AwardSpec, ...]:
    """Default specs, optionally restricted to ``ids`` and with thresholds overridden by id or code."""
    thresholds = thresholds or {}
    keep = set(ids) if ids is not None else None
    out = []
    for s in DEFAULT_AWARDS:
        if keep is not None and s.id not in keep:
            continue
        t = thresholds.get(s.id, thresholds.get(s.code, s.threshold))
        out.append(replace(s, threshold=int(t)))
    return tuple(out)


# ---------------------------------------------------------------------------
# shared aggregate
# ---------------------------------------------------------------------------

def classified_posts(
    fact: DataFrame,
    keys: Sequence[str] = ("region", "email"),
    qsource: Column | None = None,
    workout: Column | None = None,
) -> DataFrame:
    """Narrow projection of the post fact with the two class flags.

    A fact whose events were classified before the join (``facts.class_posts``)
    brings ``is_qs`` and ``is_w``; a fact with write-ups is classified here.
    ``qsource`` / ``workout`` replace the built-in classifiers (the source lets
    callers inject these predicates); a NULL result counts as not passing.
    """
    known = {"is_qs", "is_w"} <= set(fact.columns)

    def flag(given: Column | None, name: str, built_in: Callable[[str, str], Column]) -> Column:
        if given is not None:
            return F.coalesce(given, F.lit(False))
        return F.col(name) if known else built_in("backblast", "ao")

    return fact.select(
        *keys,
        "ao_id",
        "ao",
        "date",
        F.col("q_flag").cast("int").alias("q_flag"),
        flag(qsource, "is_qs", is_qsource).alias("is_qs"),
        flag(workout, "is_w", is_workout).alias("is_w"),
    )


STAT_COLUMNS = ("n_qs", "d_qs", "n_wq", "d_wq", "n_w", "n_w_ao", "d_w")
_PERIOD_OF = {"year": F.year, "month": F.month, "week": F.weekofyear}


def day_counts(posts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Posts per (person, site, day, class flags): the only aggregate over the posts themselves.

    ``posts`` comes from ``classified_posts``. Its partial aggregates leave a
    task as one row a group; the groups of one person are spread over all
    tasks. Columns: keys, ao_id, date, is_qs, is_w, led, named, n.
    """
    return (
        posts.select(*keys, "ao_id", "date", "is_qs", "is_w", F.coalesce(F.col("q_flag") == 1, F.lit(False)).alias("led"), F.col("ao").isNotNull().alias("named"))
        .groupBy(*keys, "ao_id", "date", "is_qs", "is_w", "led", "named")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _sites_kind(period: str, counter: str) -> str:
    return f"{period}_sites_{counter}"


def _counts_towards(counter: str) -> Column:
    if counter == "qs":
        return F.col("is_qs")
    return F.col("is_w") & F.col("led") if counter == "wq" else F.col("is_w")


def _memberships(specs: Sequence[AwardSpec]) -> Column:
    """The (kind, period, site) groups a day row belongs to, for the groupings the specs need.

    Period totals hold every row; per-site groups only the rows their awards count.
    """
    wanted: dict[str, tuple[str, Column | None]] = {}
    for s in specs:
        base = s.period.removesuffix("_ao")
        if s.measure == "sites":
            wanted[_sites_kind(base, s.counter)] = base, _counts_towards(s.counter)
        elif s.period != base:
            before = wanted[s.period][1] if s.period in wanted else F.lit(False)
            wanted[s.period] = base, before | _counts_towards(s.counter)
        else:
            wanted[s.period] = base, None
    groups = []
    for kind, (base, rows) in sorted(wanted.items()):
        site = F.lit(None).cast("string") if rows is None else F.col("ao_id")
        group = F.struct(F.lit(kind).alias("kind"), _PERIOD_OF[base]("date").alias("period"), site.alias("site"))
        groups.append(group if rows is None else F.when(rows, group))
    return F.array_compact(F.array(*groups))


def period_stats(
    fact: DataFrame,
    specs: Sequence[AwardSpec] = DEFAULT_AWARDS,
    keys: Sequence[str] = ("region", "email"),
    qsource: Column | None = None,
    workout: Column | None = None,
) -> DataFrame:
    """Per (keys, kind, period, ao_id) counters for every grouping the specs need.

    ``day_counts``, clustered by person, is exploded into the groups of each
    row and counted twice without a further exchange: per (kind, period,
    site), then with the sites of the distinct-site kinds counted into one row. A
    NULL site counts once, like a distinct count that treats NULL as a value.

    ``keys`` are the person keys (region and email by default; email alone when
    the region is attached after aggregating, see ``earned_awards_by_home``).
    Columns: keys, kind, period, ao_id, n_qs, d_qs, n_wq, d_wq, n_w, n_w_ao, d_w, n_sites.
    """
    keys = list(keys)
    days = day_counts(classified_posts(fact, keys, qsource, workout), keys).repartition(*keys)
    at = days.withColumn("g", F.explode(_memberships(specs))).withColumns({"kind": F.col("g.kind"), "period": F.col("g.period"), "site": F.col("g.site")})

    def posts(rows: Column, of: str = "ao_id") -> Column:
        present = F.col("ao_id").isNotNull() if of == "ao_id" else F.col("named")
        return F.sum(F.when(rows & present, F.col("n")).otherwise(0))

    def last(rows: Column) -> Column:
        return F.max(F.when(rows, F.col("date")))

    qs, w, wq = F.col("is_qs"), F.col("is_w"), F.col("is_w") & F.col("led")
    per_site = at.groupBy(*keys, "kind", "period", "site").agg(
        posts(qs).alias("n_qs"),
        last(qs).alias("d_qs"),
        posts(wq).alias("n_wq"),
        last(wq).alias("d_wq"),
        # posts per year/week count ao_id; posts per site count the site name
        posts(w).alias("n_w"),
        posts(w, "ao").alias("n_w_ao"),
        last(w).alias("d_w"),
    )
    of_sites = F.col("kind").contains("_sites_")
    merged = [(F.sum if c.startswith("n_") else F.max)(c).alias(c) for c in STAT_COLUMNS]
    return (
        per_site.withColumns({"ao_id": F.when(~of_sites, F.col("site")), "one": F.when(of_sites, F.lit(1))})
        .groupBy(*keys, "kind", "period", "ao_id")
        .agg(*merged, F.count("one").alias("n_sites"))
        .select(*keys, "kind", "period", "ao_id", *STAT_COLUMNS, F.when(of_sites, F.col("n_sites")).alias("n_sites"))
    )


def _measure(spec: AwardSpec) -> tuple[str, Column, Column]:
    """(stats kind, measure, date) of an award."""
    if spec.measure == "sites":
        return _sites_kind(spec.period, spec.counter), F.col("n_sites"), F.col(f"d_{spec.counter}")
    if spec.period.endswith("_ao"):
        return spec.period, F.col("n_w_ao"), F.col("d_w")
    return spec.period, F.col(f"n_{spec.counter}"), F.col(f"d_{spec.counter}")


def awards_from_stats(stats: DataFrame, specs: Sequence[AwardSpec] = DEFAULT_AWARDS) -> DataFrame:
    """Award rows (AWARD_COLUMNS) from ``period_stats`` output: a per-row projection + explode, no shuffle.

    Per-site awards keep one row per site that reached the threshold (the site
    itself is not reported), like the source.
    """
    candidates = []
    kinds = set()
    for s in specs:
        kind, n, d = _measure(s)
        kinds.add(kind)
        hit = (F.col("kind") == kind) & (n >= F.lit(s.threshold))
        candidates.append(
            F.when(hit, F.struct(F.lit(s.id).alias("id"), F.lit(s.period_kind).alias("pk"), d.alias("d")))
        )
    kinds = sorted(kinds)
    return (
        stats.where(F.col("kind").isin(kinds))
        .select("region", "email", "period", F.explode(F.array_compact(F.array(*candidates))).alias("a"))
        .select(
            F.col("a.id").cast("int").alias("achievement_id"),
            F.col("a.pk").alias("period_kind"),
            F.col("period").cast("int").alias("period"),
            "email",
            "region",
            F.col("a.d").alias("date_awarded"),
        )
    )


def earned_awards(
    fact: DataFrame,
    specs: Sequence[AwardSpec] = DEFAULT_AWARDS,
    qsource: Column | None = None,
    workout: Column | None = None,
) -> DataFrame:
    """All awards earned in ``fact`` (one calendar year of posts, with home ``region``).

    ``qsource`` / ``workout`` optionally replace the event-class predicates.
    Output columns: achievement_id, period_kind, period, email, region, date_awarded.
    ``date_awarded`` is the last qualifying post of the period so far.
    """
    return awards_from_stats(period_stats(fact, specs, qsource=qsource, workout=workout), specs)


def earned_awards_by_home(
    posts: DataFrame,
    home: DataFrame,
    specs: Sequence[AwardSpec] = DEFAULT_AWARDS,
    qsource: Column | None = None,
    workout: Column | None = None,
) -> DataFrame:
    """Awards of every person's national posts, credited to the person's home region.

    Equal to ``earned_awards(attach_home_region(posts, home))`` because the home
    region is a function of the email: the counters are aggregated per email
    first and the region joins onto the aggregated rows, so the post-level
    home-region join (a full shuffle of the fact) is not needed. People
    without a home region drop out, as with the inner join.
    """
    stats = period_stats(posts, specs, keys=("email",), qsource=qsource, workout=workout)
    stats = stats.join(home.select("email", "region"), "email")
    return awards_from_stats(stats, specs)


def yearly_posts(fact: DataFrame, workout: Column | None = None) -> DataFrame:
    """Workout posts per person and year with the last post date (the base of the post-count tiers)."""
    posts = classified_posts(fact, workout=workout).where(F.col("is_w"))
    return posts.groupBy(F.year("date").alias("year"), "email", "region").agg(
        F.count("ao_id").alias("n_posts"), F.max("date").alias("last_date")
    )
