"""Joins and sets of packages, their files, owners, tags and releases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.operators.names import neighbourhood, swapped
from tallyward.plans.lineage import cut


def united(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows of several tables of the same columns, the first of each key by the place of its table; one shuffle."""
    every = reduce(DataFrame.unionByName, [p.withColumn("part_", F.lit(k)) for k, p in enumerate(parts)])
    rest = [c for c in parts[0].columns if c not in keys]
    return every.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("part_", *rest)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def difference_counts(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, only_a, only_b, in_both): the sizes of the symmetric difference and of what is common."""
    x = a.select(by, *keys).distinct().withColumn("a_", F.lit(1))
    y = b.select(by, *keys).distinct().withColumn("b_", F.lit(1))
    j = x.join(y, [by, *keys], "full_outer")
    return j.groupBy(by).agg(F.count_if(F.col("b_").isNull()).alias("only_a"), F.count_if(F.col("a_").isNull()).alias("only_b"), F.count_if(F.col("a_").isNotNull() & F.col("b_").isNotNull()).alias("in_both"))


def merged_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (keys, low, high), high excluded, without repeated and contained ones; those that touch are one."""
    w = Window.partitionBy(*keys).orderBy("low", "high")
    r = ranges.filter("low < high").withColumn("reach_", F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("group_", F.sum(F.when(F.col("reach_").isNull() | (F.col("low") > F.col("reach_")), 1).otherwise(0)).over(w))
    return r.groupBy(*keys, "group_").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("group_")


def round_robin(ranked: DataFrame, lists: str, rank: str, key: str, most: int) -> DataFrame:
    """(place, key): ranked lists merged by turns, each key where it comes first; the first ``most``.

    Turns are ordered by rank and list, so a key's first turn is a minimum and no list is walked in one place; only the
    ``most`` first are ordered.
    """
    first = ranked.groupBy(key).agg(F.min(F.struct(F.col(rank), F.col(lists))).alias("turn"))
    top = first.orderBy("turn", key).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("turn", key))).select("place", key)


def folded(text: Column) -> Column:
    """A description as compared: lower case, other characters than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def copies(repositories: DataFrame) -> DataFrame:
    """(name, id, copy_of): repositories with the name and the description of an older one of another owner.

    repositories: (id, owner, name, about, created).  The oldest of each name and description stands for it, so a
    group of many copies gives a row for each and not for each pair.
    """
    keyed = repositories.withColumns({"name_": F.lower("name"), "about_": folded(F.col("about"))}).filter("about_ != ''")
    first = keyed.groupBy("name_", "about_").agg(F.min(F.struct("created", "id", "owner")).alias("first"))
    return keyed.join(first, ["name_", "about_"]).filter("owner != first.owner").select("name", "id", F.col("first.id").alias("copy_of"))


def owner_lookalikes(names: DataFrame, known: DataFrame) -> DataFrame:
    """(owner, name, target): packages named as a known one (owner, name) by an owner one edit or swap from its owner."""
    a = names.select("owner", "name").distinct().withColumn("key_", F.explode(neighbourhood(F.col("owner"))))
    b = known.select(F.col("owner").alias("target"), "name").distinct().withColumn("key_", F.explode(neighbourhood(F.col("target"))))
    near = (F.levenshtein("owner", "target", 1) == 1) | swapped(F.col("owner"), F.col("target"))
    return a.join(b, ["name", "key_"]).filter((F.col("owner") != F.col("target")) & near).select("owner", "name", "target").distinct()


def separator_twins(names: DataFrame) -> DataFrame:
    """(name, twin): names that differ in case and separators only; the least of them is the twin of the others."""
    n = names.select("name").distinct().withColumn("key_", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", ""))
    least = n.groupBy("key_").agg(F.min("name").alias("twin"), F.count("*").alias("n")).filter("n > 1")
    return n.join(least, "key_").filter("name != twin").select("name", "twin")


def moved_tags(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_sha, last_sha, moves) of tags that have pointed to more than one commit; sightings: (keys, sha, at)."""
    w = Window.partitionBy(*keys).orderBy("at", "sha")
    turned = sightings.withColumn("moved_", (F.lag("sha").over(w) != F.col("sha")).cast("long"))
    every = turned.groupBy(*keys).agg(F.min_by("sha", F.struct("at", "sha")).alias("first_sha"), F.max_by("sha", F.struct("at", "sha")).alias("last_sha"), F.coalesce(F.sum("moved_"), F.lit(0)).alias("moves"))
    return every.filter("moves > 0")


def pin_states(uses: DataFrame, tags: DataFrame, commits: DataFrame) -> DataFrame:
    """(id, state) of action references (id, repo, ref, comment): unpinned, impostor, mismatch or pinned.

    A reference by commit is an impostor's if the repository does not have the commit (repo, sha), and a mismatch if the
    tag that its comment names (repo, tag, sha) is of another commit.
    """
    pinned = F.col("ref").rlike("^[0-9a-f]{40}$")
    have = commits.select("repo", F.col("sha").alias("ref"), F.lit(True).alias("known_")).distinct()
    named = tags.select("repo", F.col("tag").alias("comment"), F.col("sha").alias("tag_sha_"))
    j = uses.join(have, ["repo", "ref"], "left").join(named, ["repo", "comment"], "left")
    state = F.when(~pinned, "unpinned").when(F.col("known_").isNull(), "impostor").when(F.col("tag_sha_") != F.col("ref"), "mismatch").otherwise("pinned")
    return j.select("id", state.alias("state"))


def wheel_tags(file: Column) -> Column:
    """(name, version, build, python, abi, platform) of a wheel's file name; null if it is not one."""
    parts = F.split(F.regexp_replace(file, r"[.]whl$", ""), "-")
    n = F.size(parts)
    at = lambda k: F.try_element_at(parts, F.lit(k))
    fits = file.rlike(r"[.]whl$") & n.isin(5, 6)
    return F.when(fits, F.struct(at(1).alias("name"), at(2).alias("version"), F.when(n == 6, at(3)).alias("build"), at(-3).alias("python"), at(-2).alias("abi"), at(-1).alias("platform")))


def comparable_wheels(a: Column, b: Column) -> Column:
    """Whether two wheels are for the same interpreter and platform family, so that their files can be compared."""
    family = lambda w: F.regexp_replace(w["platform"], "_[0-9_]+", "")
    return (F.substring(a["python"], 1, 2) == F.substring(b["python"], 1, 2)) & (family(a) == family(b))


def reachable(starts: DataFrame, steps: DataFrame, most_rounds: int = 20) -> DataFrame:
    """(package, file, depth): files reached from the starts (package, file) by steps (package, file, target).

    A breadth-first walk of all packages at once: each round joins the newest files only, and ends when there are none.
    """
    found = cut(starts.select("package", "file").distinct().withColumn("depth", F.lit(0)))
    newest, steps = found, cut(steps.select("package", "file", "target").distinct())
    for depth in range(1, most_rounds + 1):
        following = newest.join(steps, ["package", "file"]).select("package", F.col("target").alias("file")).distinct().join(found, ["package", "file"], "left_anti")
        newest = cut(following.withColumn("depth", F.lit(depth)))
        if not newest.limit(1).count():
            return found
        found = cut(found.unionByName(newest))
    raise RuntimeError(f"steps go on after {most_rounds} rounds")


def hook_targets(hooks: DataFrame) -> DataFrame:
    """(package, file, command): the files that hook commands (package, command) run with an interpreter or directly."""
    step = F.explode(F.split("command", r"\s*(?:&&|\|\||;)\s*"))
    parts = hooks.select("package", step.alias("command"))
    file = F.regexp_extract("command", r"^(?:(?:node|python3?|sh|bash)\s+)?(?:\./)?([\w./-]+\.(?:js|cjs|mjs|py|sh))\b", 1)
    return parts.withColumn("file", file).filter("file != ''").select("package", "file", "command")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(package, file, target): imports (package, file, module) of modules that are files (package, file) of the package.

    A module a.b is a/b.py, a/b/__init__.py or a/b.js; one of relative dots or slashes is read likewise.
    """
    base = F.regexp_replace(F.regexp_replace("module", r"^\.+/?", ""), r"\.", "/")
    forms = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), F.concat(base, F.lit(".js")))
    wanted = imports.select("package", "file", F.explode(forms).alias("target"))
    return wanted.join(files.select("package", F.col("file").alias("target")).distinct(), ["package", "target"]).select("package", "file", "target").distinct()


def tainted_sinks(facts: DataFrame, most_rounds: int = 20) -> DataFrame:
    """(file, line_no, variable): sinks whose variable holds, by its last assignment before, what came from a source.

    facts: (file, line_no, kind, variable, of): kind "source" (variable from outside), "copy" (variable from variable
    ``of``), "clean" (variable sanitised) or "sink" (use of variable).  What each use and copy sees is an as-of lookup of
    the last assignment; taint then goes along copies until no more is found, for all files at once.
    """
    order = Window.partitionBy("file", "name_").orderBy("line_no", "use_")
    assigned = facts.filter("kind != 'sink'").select("file", "line_no", F.col("variable").alias("name_"), F.lit(1).alias("use_"), F.struct("line_no", "kind", F.lit(True).alias("set")).alias("here_"), F.lit(None).cast("string").alias("into_"))
    used = facts.filter("kind = 'sink' or kind = 'copy'").select("file", "line_no", F.when(F.col("kind") == "copy", F.col("of")).otherwise(F.col("variable")).alias("name_"), F.lit(0).alias("use_"), F.lit(None).cast("struct<line_no:bigint,kind:string,set:boolean>").alias("here_"), F.when(F.col("kind") == "copy", F.col("variable")).alias("into_"))
    assigned = assigned.withColumn("here_", F.col("here_").cast("struct<line_no:bigint,kind:string,set:boolean>"))
    seen = assigned.unionByName(used).withColumn("last_", F.last("here_", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("use_ = 0 and last_ is not null")
    seen = cut(seen.select("file", "line_no", F.col("name_").alias("variable"), "into_", F.col("last_.line_no").alias("from_line"), F.col("last_.kind").alias("from_kind")))
    tainted = cut(facts.filter("kind = 'source'").select("file", "line_no", "variable").distinct())
    newest = tainted
    for _ in range(most_rounds):
        see = seen.filter("into_ is not null").join(newest.select("file", F.col("line_no").alias("from_line"), "variable"), ["file", "from_line", "variable"])
        newest = cut(see.select("file", "line_no", F.col("into_").alias("variable")).distinct().join(tainted, ["file", "line_no", "variable"], "left_anti"))
        if not newest.limit(1).count():
            break
        tainted = cut(tainted.unionByName(newest))
    else:
        raise RuntimeError(f"copies go on after {most_rounds} rounds")
    return seen.filter("into_ is null").join(tainted.select("file", F.col("line_no").alias("from_line"), "variable"), ["file", "from_line", "variable"]).select("file", "line_no", "variable").distinct()


def provenance_changes(releases: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``change``: dropped (had an attestation, has none), takeover (another source repository), changed (another
    workflow), added or same, against the release before; null for the first."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct("attested", "repository", "workflow")).over(w)
    r = releases.withColumn("before_", before)
    was, now = F.col("before_.attested"), F.col("attested")
    state = F.when(F.col("before_").isNull(), None).when(was & ~now, "dropped").when(~was & now, "added").when(~now, "same")
    state = F.coalesce(state, F.when(F.col("before_").isNull(), None).when(F.col("before_.repository") != F.col("repository"), "takeover").when(F.col("before_.workflow") != F.col("workflow"), "changed").otherwise("same"))
    return r.withColumn("change", state).drop("before_")


def yanks_by_publisher(releases: DataFrame, yanks: DataFrame, hours: int = 24, least: int = 2) -> DataFrame:
    """(package, release, yanks): releases within so many hours of yanks of the same package by the same account, if
    some stable version was released before; two yanks or more.

    releases: (package, account, release, at_us, stable); yanks: (package, account, at_us).
    """
    span = hours * 3_600_000_000
    first = releases.filter("stable").groupBy("package").agg(F.min("at_us").alias("stable_us"))
    r = releases.join(first, "package").filter("stable_us < at_us").withColumn("b_", F.floor(F.col("at_us") / span))
    y = yanks.select("package", "account", F.col("at_us").alias("y_us"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("at_us") / span) + k)).alias("b_"))
    near = r.join(y, ["package", "account", "b_"]).filter(F.abs(F.col("at_us") - F.col("y_us")) <= span)
    return near.groupBy("package", "release").agg(F.count("*").alias("yanks")).filter(F.col("yanks") >= least)


def vendored(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(tree, path, state): vendored files (tree, path, digest) against their manifest: altered, unlisted, missing."""
    m = manifest.select("tree", "path", F.col("digest").alias("listed_"))
    j = files.join(m, ["tree", "path"], "full_outer")
    state = F.when(F.col("listed_").isNull(), "unlisted").when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("listed_"), "altered")
    return j.select("tree", "path", state.alias("state")).filter("state is not null")


def new_against(findings: DataFrame, baseline: DataFrame, trusted: bool = True) -> DataFrame:
    """Findings whose ``print`` is not in the baseline; all of them if the baseline can't be trusted."""
    return findings.join(baseline.select("print").distinct(), "print", "left_anti") if trusted else findings
