"""The profile fold and the replay as recursive SQL (oracle text for DuckDB).

One row of the recursion is the profile of a run after some of its reactions: lists of the
slots' items, preferences and counts, the number of rewards and their mean. A step joins the
run's next reaction. The gradient update goes slot by slot over the current values, as a left
fold whose first element is the preference list and whose further elements are slot numbers.
"""

from __future__ import annotations

DECAY = 0.95

SIMILARITIES = """SELECT a.item_id, list(list_cosine_similarity(a.v, b.v) ORDER BY b.item_id) AS sims
    FROM (SELECT item_id, CAST(embedding AS DOUBLE[]) AS v FROM items) a, (SELECT item_id, CAST(embedding AS DOUBLE[]) AS v FROM items) b
    GROUP BY a.item_id"""

ORDERED = """SELECT r.*, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM reactions r"""


def _react(source: str) -> str:
    """Rows of ``source`` (a profile, its settings, the next reaction's item_id, sims and reward) after that reaction."""
    decayed = f"""SELECT *, list_transform(prefs, lambda x: x * {DECAY}) AS faded,
        coalesce(list_position(list_transform(items, lambda i: sims[i + 1] >= gamma), true), 0) AS hit FROM ({source})"""
    bounds = """CASE WHEN len(list_filter(counts, lambda c: c >= min_samples)) > 0
        THEN list_transform(faded, lambda x, j: CASE WHEN counts[j] >= min_samples THEN x - beta * sqrt(1.0 / counts[j]) ELSE 'infinity'::DOUBLE END)
        ELSE faded END"""
    leaving = f"""SELECT *, CASE WHEN hit = 0 AND len(items) > max_embeddings THEN list_position({bounds}, list_min({bounds})) ELSE 0 END AS gone FROM ({decayed})"""

    def without(column: str) -> str:
        return f"CASE WHEN gone > 0 THEN list_concat({column}[:gone - 1], {column}[gone + 1:]) ELSE {column} END"

    def grown(column: str, new: str) -> str:
        return f"CASE WHEN hit > 0 THEN {column} ELSE list_append({without(column)}, {new}) END"

    placed = f"""SELECT * EXCLUDE (items, counts, faded), {grown('items', 'item_id')} AS items, {grown('counts', '0::BIGINT')} AS counts,
        {grown('faded', '0.0::DOUBLE')} AS faded, alpha * (reward - avg) AS step FROM ({leaving})"""
    chosen = f"SELECT *, CASE WHEN hit > 0 THEN hit ELSE len(items) END AS chosen, list_max(faded) AS top FROM ({placed})"
    slots = "list_transform(range(1, len(faded) + 1), lambda j: [CAST(j AS DOUBLE)])"
    share = "exp(x - top) / list_sum(list_transform(acc, lambda z: exp(z - top)))"
    updated = f"""list_reduce(list_prepend(faded, {slots}), lambda acc, s: list_transform(acc, lambda x, j:
        CASE WHEN j = s[1] THEN x + step * ((CASE WHEN j = chosen THEN 1.0 ELSE 0.0 END) - {share}) ELSE x END))"""
    return f"""SELECT * REPLACE (list_transform(counts, lambda c, j: CASE WHEN j = chosen THEN c + 1 ELSE c END) AS counts),
        {updated} AS new_prefs, total + 1 AS new_total, avg + (reward - avg) / (total + 1) AS new_avg,
        matches + CASE WHEN hit > 0 THEN 1 ELSE 0 END AS new_matches, evictions + CASE WHEN gone > 0 THEN 1 ELSE 0 END AS new_evictions
        FROM ({chosen})"""


EMPTY = """0::BIGINT AS pos, []::BIGINT[] AS items, []::DOUBLE[] AS prefs, []::BIGINT[] AS counts, 0::BIGINT AS total, 0.0::DOUBLE AS avg,
    0::BIGINT AS matches, 0::BIGINT AS evictions"""


def fold_ctes(params, ordered: str = ORDERED) -> dict[str, str]:
    """CTEs (name -> text) that end in ``fold_slots``: the final slots of every user."""
    settings = f"""{params.alpha}::DOUBLE AS alpha, {params.gamma}::DOUBLE AS gamma, {params.beta}::DOUBLE AS beta,
        {params.max_embeddings} AS max_embeddings, {params.min_samples} AS min_samples"""
    source = f"""SELECT f.*, e.item_id, e.reward, e.sims, {settings} FROM fold f JOIN stepped e ON e.user_id = f.user_id AND e.pos = f.pos + 1"""
    step = f"SELECT user_id, pos + 1, items, new_prefs, counts, new_total, new_avg, new_matches, new_evictions FROM ({_react(source)})"
    return {
        "similarities": SIMILARITIES,
        "stepped": f"SELECT o.*, s.sims FROM ({ordered}) o JOIN similarities s USING (item_id)",
        "fold": f"SELECT DISTINCT user_id, {EMPTY} FROM stepped UNION ALL {step}",
        "fold_end": "SELECT f.* FROM fold f JOIN (SELECT user_id, max(pos) AS pos FROM stepped GROUP BY user_id) USING (user_id, pos)",
        "fold_slots": """SELECT user_id, CAST(slot - 1 AS BIGINT) AS slot, items[slot] AS item_id, prefs[slot] AS preference, counts[slot] AS rewards_received,
            total AS total_rewards, avg AS reward_average, matches, evictions
            FROM (SELECT *, unnest(range(1, len(items) + 1)) AS slot FROM fold_end)""",
    }


def replay_ctes(grid_sql: str, uniform, seed: int, min_samples: int) -> dict[str, str]:
    """CTEs that end in ``replayed``: every step of every (configuration, profile, user) run.

    ``grid_sql`` gives config_id and the parameters; ``sim`` (profile, user_id, ts, event_id,
    item_id, category, sim_reward) must be there. ``uniform`` is the SQL of a keyed draw.
    """
    draw = lambda what: uniform(str(seed), "config_id", "user_id", "event_id", f"'{what}'")
    source = """SELECT p.* EXCLUDE (accepted, category, reward), g.alpha, g.gamma, g.beta, g.max_embeddings, g.exp_rate, {min_samples} AS min_samples, e.event_id, e.item_id, e.category, e.sim_reward AS reward, e.sims
        FROM replayed p JOIN grid g USING (config_id) JOIN stepped e ON e.profile = p.profile AND e.user_id = p.user_id AND e.pos = p.pos + 1""".replace("{min_samples}", str(min_samples))
    weighed = f"""SELECT *, list_transform(prefs, lambda x, j: beta * ln(total) / counts[j] + x) AS ucb FROM ({source})"""
    weighed = f"""SELECT *, list_transform(ucb, lambda x: exp(x - list_max(ucb))) AS z, {draw('slot')} AS drawn FROM ({weighed})"""
    picked = f"""SELECT *, coalesce(list_position(list_transform(z, lambda x, j: list_sum(z[:j]) / list_sum(z) > drawn), true), 0) AS found FROM ({weighed})"""
    judged = f"""SELECT * EXCLUDE (ucb, z, drawn, found), CASE WHEN len(items) = 0 THEN true WHEN {draw('gate')} < exp_rate THEN true
        ELSE sims[items[CASE WHEN found > 0 THEN found ELSE len(items) END] + 1] >= gamma END AS accept FROM ({picked})"""
    step = f"""SELECT config_id, profile, user_id, pos + 1, items, new_prefs, counts, new_total, new_avg, new_matches, new_evictions, true, category, reward
        FROM ({_react(f"SELECT * FROM ({judged}) WHERE accept")})"""
    same = f"""SELECT config_id, profile, user_id, pos + 1, items, prefs, counts, total, avg, matches, evictions, false, category, reward
        FROM ({judged}) WHERE NOT accept"""
    return {
        "similarities": SIMILARITIES,
        "stepped": """SELECT o.*, s.sims FROM (SELECT *, row_number() OVER (PARTITION BY profile, user_id ORDER BY ts, event_id) AS pos FROM sim) o
            JOIN similarities s USING (item_id)""",
        "grid": grid_sql,
        "replayed": f"""SELECT g.config_id, r.profile, r.user_id, {EMPTY}, false AS accepted, NULL::VARCHAR AS category, 0.0::DOUBLE AS reward
            FROM grid g, (SELECT DISTINCT profile, user_id FROM stepped) r UNION ALL ({step} UNION ALL {same})""",
    }
