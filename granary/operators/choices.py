"""Configurable products: options in groups, rules that disable options, prices, the space of options.

Groups and rules that come as lists are configuration. They become expressions when the plan
is built: ``groups``: id, default, options (list of ids). ``rules``: when and disable (group
to options), reason. A rule holds when all its groups match; it never holds for a group that
stands in its own condition.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_defaults(states: DataFrame, groups: DataFrame, options: DataFrame) -> DataFrame:
    """(state, group_id, option_id) for every group; a missing or unknown choice is the default.

    ``states``: state, picks (map of group to option). ``groups``: group_id, default_option.
    ``options``: group_id, option_id, price.
    """
    rows = states.select("state", "picks").crossJoin(F.broadcast(groups))
    picked = rows.withColumn("_pick", F.try_element_at("picks", F.col("group_id")))
    known = options.select(F.col("group_id").alias("_g"), F.col("option_id").alias("_o"))
    joined = picked.join(F.broadcast(known), (F.col("group_id") == F.col("_g")) & (F.col("_pick") == F.col("_o")), "left")
    return joined.select("state", "group_id", F.coalesce("_o", "default_option").alias("option_id"))


def disabled(chosen: DataFrame, rules: DataFrame) -> DataFrame:
    """(state, group_id, option_id, reason): options a rule forbids, with its first reason.

    ``rules``: rule, reason, when_group, when_options (array), group_id, option_id; a row
    for each condition and each disabled option. A rule holds when all its groups match.
    """
    need = rules.groupBy("rule").agg(F.count_distinct("when_group").alias("need"))
    met = chosen.select("state", F.col("group_id").alias("when_group"), F.col("option_id").alias("_o")).join(F.broadcast(rules), "when_group").filter(F.array_contains("when_options", F.col("_o")))
    held = met.groupBy("state", "rule").agg(F.count_distinct("when_group").alias("n")).join(F.broadcast(need), "rule").filter("n = need")
    effects = rules.select("rule", "reason", "group_id", "option_id").distinct()
    return held.join(F.broadcast(effects), "rule").groupBy("state", "group_id", "option_id").agg(F.min_by("reason", "rule").alias("reason"))


def price(chosen: DataFrame, options: DataFrame, base: int) -> DataFrame:
    """(state, price): the base and the prices of the chosen options."""
    return chosen.join(F.broadcast(options), ["group_id", "option_id"], "left").groupBy("state").agg((F.lit(base) + F.sum(F.coalesce("price", F.lit(0)))).alias("price"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _holds(rule: dict, state, group: str) -> Column:
    """Whether a rule holds for a group; ``state``: function of a group's id, null for no such group."""
    if group in rule.get("when", {}):
        return F.lit(False)
    return reduce(lambda a, b: a & b, (F.coalesce(state(k).isin(*v), F.lit(False)) if v else F.lit(False) for k, v in rule.get("when", {}).items()), F.lit(True))


def _reason(rules: list[dict], state, group: str, option: Column) -> Column:
    """Reason of the first rule that forbids an option in a state, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        listed = rule.get("disable", {}).get(group)
        if listed:
            out = F.when(option.isin(*listed) & _holds(rule, state, group), F.lit(rule.get("reason", "not available"))).otherwise(out)
    return out


def _reader(groups: list[dict], state: Column):
    known = {g["id"]: f"g{k}" for k, g in enumerate(groups)}
    return lambda group: state[known[group]] if group in known else F.lit(None).cast("string")


def _complete(picks: Column, groups: list[dict]) -> Column:
    """A struct with a field for each group; a missing or unknown pick is the default."""
    picked = [(g, F.try_element_at(picks, F.lit(g["id"]))) for g in groups]
    return F.struct(*[F.when(x.isin(*g["options"]), x).otherwise(F.lit(g["default"])).alias(f"g{k}") for k, (g, x) in enumerate(picked)])


def _settled(groups: list[dict], rules: list[dict], state: Column, held: Column) -> Column:
    """A state without forbidden options: each is replaced by the default of its group, or by the
    first option that is free, group after group and as often as there are groups, and once more.
    The group ``held`` stays as it is; so does a group without a free option."""

    def replaced(k: int):
        own = groups[k]

        def step(now: Column) -> Column:
            at, current = _reader(groups, now), now[f"g{k}"]
            free = [F.when((current != F.lit(o)) & _reason(rules, at, own["id"], F.lit(o)).isNull(), F.lit(o)) for o in dict.fromkeys([own["default"], *own["options"]])]
            stays = F.coalesce(held == F.lit(own["id"]), F.lit(False)) | _reason(rules, at, own["id"], current).isNull()
            value = F.when(stays, current).otherwise(F.coalesce(*free, current))
            return F.struct(*[(value if j == k else now[f"g{j}"]).alias(f"g{j}") for j in range(len(groups))])

        return step

    def one_pass(now: Column, _: Column) -> Column:
        for k, g in enumerate(groups):
            if any(r.get("disable", {}).get(g["id"]) for r in rules):
                now = _let(now, replaced(k))
        return now

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(groups))), state, one_pass)


def _as_map(groups: list[dict], state: Column) -> Column:
    return F.create_map(*[x for k, g in enumerate(groups) for x in (F.lit(g["id"]), state[f"g{k}"])])


def resolve(picks: Column, groups: list[dict], rules: list[dict]) -> Column:
    """The settled state of a map of picks: defaults for what is missing or unknown, no forbidden option."""
    return _let(_settled(groups, rules, _complete(picks, groups), F.lit(None).cast("string")), lambda s: _as_map(groups, s))


def select(picks: Column, group: Column, option: Column, groups: list[dict], rules: list[dict]) -> Column:
    """struct(state, blocked): the state after one choice; with a reason in ``blocked`` it stays as it was."""

    def chosen(state: Column) -> Column:
        known = reduce(lambda a, b: a | b, ((group == F.lit(g["id"])) & option.isin(*g["options"]) for g in groups))
        reasons = F.coalesce(*[F.when(group == F.lit(g["id"]), _reason(rules, _reader(groups, state), g["id"], option)) for g in groups])
        blocked = F.when(F.coalesce(known, F.lit(False)), reasons).otherwise(F.lit("unknown option"))
        after = F.struct(*[F.when(group == F.lit(g["id"]), option).otherwise(state[f"g{k}"]).alias(f"g{k}") for k, g in enumerate(groups)])

        def outcome(why: Column) -> Column:
            state_after = F.when(why.isNotNull(), state).otherwise(_settled(groups, rules, after, group))
            return F.struct(_let(state_after, lambda s: _as_map(groups, s)).alias("state"), why.alias("blocked"))

        return _let(blocked, outcome)

    return _let(_settled(groups, rules, _complete(picks, groups), F.lit(None).cast("string")), chosen)


# ---- the space of options


def configurations(options: DataFrame, groups: list[str], rules: list[dict]) -> DataFrame:
    """(product, a column for each group): every choice of one option of each group that no rule forbids.

    ``options``: product, group_id, option_id; repeated rows count once, rows with a null are
    left out, and so is a product that lacks a group. Groups are joined one by one on the
    product; a rule is applied as soon as all its groups are there, so forbidden beginnings
    are not carried on.
    """
    if {"product"} & set(groups):
        raise ValueError("a group cannot be named product")
    given = options.select("product", "group_id", "option_id").dropna().distinct()
    states, placed, open_rules = None, [], list(enumerate(rules))
    for g in groups:
        own = given.filter(F.col("group_id") == g).select("product", F.col("option_id").alias(g))
        states = own if states is None else states.join(own, "product")
        placed.append(g)
        ready = [(k, r) for k, r in open_rules if {*r.get("when", {}), *r.get("disable", {})} & set(groups) <= set(placed)]
        for _, rule in ready:
            for d in rule.get("disable", {}):
                if d in placed and rule["disable"][d]:
                    at = lambda key: F.col(f"`{key}`") if key in placed else F.lit(None).cast("string")
                    states = states.filter(~(at(d).isin(*rule["disable"][d]) & _holds(rule, at, d)))
        open_rules = [x for x in open_rules if x not in ready]
    return states


def option_use(options: DataFrame, groups: list[str], rules: list[dict]) -> DataFrame:
    """(product, group_id, option_id, states): in how many configurations each option stands; 0: it can never be chosen."""
    states = configurations(options, groups, rules)
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("group_id"), F.col(f"`{g}`").alias("option_id")) for g in groups]))
    used = states.select("product", cells.alias("c")).groupBy("product", F.col("c.group_id").alias("group_id"), F.col("c.option_id").alias("option_id")).agg(F.count("*").alias("states"))
    given = options.select("product", "group_id", "option_id").dropna().distinct().filter(F.col("group_id").isin(*groups))
    return given.join(used, ["product", "group_id", "option_id"], "left").fillna(0, ["states"])


def expanded(templates: DataFrame, options: DataFrame, groups: list[str]) -> DataFrame:
    """(product, path): templates with every {group} replaced by each option of the product, without repeats.

    ``templates``: product, template. Rules do not matter here. Unknown names stay as they are
    written; a template that names a group its product lacks has no path; null and empty
    templates have none. The options of one product, which are configuration, form one row.
    """
    known = options.dropna().filter(F.col("group_id").isin(*groups)).groupBy("product").pivot("group_id", groups).agg(F.collect_set("option_id"))
    known = known.select("product", *[F.col(f"`{g}`").alias(f"_o{k}") for k, g in enumerate(groups)])
    out = templates.filter("template <> ''").select("product", "template").distinct().join(known, "product", "left")
    for k, g in enumerate(groups):
        name = F.lit("{" + g + "}")
        each = F.transform(F.coalesce(F.col(f"_o{k}"), F.array().cast("array<string>")), partial(F.replace, F.col("template"), name))
        out = out.withColumn("template", F.explode(F.when(F.contains("template", name), each).otherwise(F.array("template"))))
    return out.select("product", F.col("template").alias("path")).distinct()


def rule_faults(rules: DataFrame, options: DataFrame) -> DataFrame:
    """(rule, part, group_id, option_id, fault): names in rules that do not exist, and groups in both parts.

    ``rules``: rule, part (when or disable), group_id, option_id. ``options``: group_id,
    option_id. A fault of a group has a null option; an option is looked for in known groups only.
    """
    named = rules.select("rule", "part", "group_id", "option_id").distinct()
    parts = named.groupBy("rule", "group_id").agg(F.count_distinct("part").alias("_parts"))
    no_option = F.lit(None).cast("string").alias("option_id")
    both = parts.filter("_parts > 1").select("rule", F.lit("disable").alias("part"), "group_id", no_option, F.lit("group in both parts").alias("fault"))
    known = options.select("group_id").distinct()
    lost = named.select("rule", "part", "group_id").distinct().join(known, "group_id", "left_anti").select("rule", "part", "group_id", no_option, F.lit("no such group").alias("fault"))
    absent = named.join(known, "group_id", "left_semi").join(options.select("group_id", "option_id").distinct(), ["group_id", "option_id"], "left_anti")
    return both.unionByName(lost).unionByName(absent.select("rule", "part", "group_id", "option_id", F.lit("no such option").alias("fault")))
