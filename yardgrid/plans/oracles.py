"""The catalogue's queries as SQL for DuckDB, written from the definitions.

``RELATIONS`` holds named relations; a query lists its own SELECT and gets the relations it
mentions, in order, as a WITH clause.
"""

from __future__ import annotations

import re


def whole(expression: str) -> str:
    """Integer result."""
    return f"CAST({expression} AS BIGINT)"


def r(expression: str, digits: int = 4) -> str:
    """Rounded double without a negative zero."""
    return f"(round({expression}, {digits}) + 0e0)"


def rounded(names: str, digits: int = 4) -> str:
    """Several columns rounded under their own names."""
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names.split())


PI = "3.141592653589793e0"
WIDTH = "(160e0 / 3e0)"
SERIAL = "((gameId - 2022000000) * 4 + playId - 1)"
KEYS = "gameId, playId, frameId, nflId"
INITIAL = "'handoff', 'run', 'lateral', 'pass_outcome_caught'"

RELATIONS: dict[str, str] = {}

RELATIONS["moves"] = """
SELECT 2022000000 + event_id // 2200 AS gameId, (event_id // 550) % 4 + 1 AS playId,
       (event_id // 22) % 25 + 1 AS frameId, event_id % 22 + 1 AS nflId,
       event_id // 550 AS serial, event_id, value, 1 + event_id // 35200 AS week,
       CASE WHEN (event_id // 22) % 25 + 1 = 1 THEN 'ball_snap'
            WHEN (event_id // 22) % 25 + 1 = 5 THEN
                CASE (event_id // 550) % 3 WHEN 0 THEN 'handoff' WHEN 1 THEN 'pass_outcome_caught' ELSE 'run' END
            WHEN (event_id // 22) % 25 + 1 = 12 AND (event_id // 550) % 5 = 0 THEN 'lateral'
            WHEN (event_id // 22) % 25 + 1 = 21 THEN
                CASE WHEN (event_id // 550) % 8 = 7 THEN 'out_of_bounds'
                     WHEN (event_id // 550) % 4 = 2 THEN 'touchdown' ELSE 'tackle' END
       END AS event
FROM events"""

RELATIONS["tracking"] = f"""
SELECT gameId, playId, frameId, event, week, nflId, 'Player ' || nflId AS displayName,
       CASE WHEN nflId <= 11 THEN 'AAA' ELSE 'BBB' END AS club,
       CASE WHEN serial % 2 = 0 THEN 'left' ELSE 'right' END AS playDirection,
       10e0 + (value * 7.31e0) % 100e0 AS x, (value * 3.17e0) % {WIDTH} AS y, value % 10e0 AS s,
       value % 4e0 AS a, value % 1e0 AS dis, CAST((event_id * 53) % 360 AS DOUBLE) AS o,
       CAST((event_id * 37) % 360 AS DOUBLE) AS dir
FROM moves
UNION ALL
SELECT gameId, playId, frameId, event, week, NULL, 'football', 'football',
       CASE WHEN serial % 2 = 0 THEN 'left' ELSE 'right' END,
       10e0 + (value * 1.93e0) % 100e0, (value * 2.71e0) % {WIDTH}, value % 7e0, value % 3e0, value % 1e0,
       NULL, NULL
FROM moves WHERE nflId = 1"""

RELATIONS["playrows"] = "SELECT DISTINCT gameId, playId FROM moves"

RELATIONS["plays"] = f"""
SELECT gameId, playId, 1 + playId AS ballCarrierId, {SERIAL} % 4 + 1 AS quarter, {SERIAL} % 4 + 1 AS down,
       {SERIAL} % 10 + 1 AS yardsToGo, 'AAA' AS possessionTeam, 'BBB' AS defensiveTeam,
       ({SERIAL} % 15) || ':30:00' AS gameClock, {SERIAL} * 7 % 49 + 1 AS yardlineNumber,
       {SERIAL} * 7 % 99 + 11 AS absoluteYardlineNumber
FROM playrows"""

RELATIONS["pbp"] = f"""
SELECT gameId AS game_id, playId AS play_id, {SERIAL} % 2 AS pass, 1 - {SERIAL} % 2 AS rush,
       CASE WHEN {SERIAL} % 7 = 6 THEN 1 ELSE 0 END AS sack,
       CASE WHEN {SERIAL} % 11 = 10 THEN 1 - {SERIAL} % 2 ELSE 0 END AS qb_scramble,
       CASE WHEN {SERIAL} % 2 = 1 THEN 'pass' ELSE 'run' END AS play_type,
       CASE WHEN {SERIAL} % 13 = 12 THEN 1 ELSE 0 END AS fumble, 'BBB' AS defteam
FROM playrows"""

RELATIONS["tackles"] = f"""
SELECT DISTINCT gameId, playId, nflId,
       CASE WHEN ({SERIAL} + nflId) % 3 = 0 THEN 1 ELSE 0 END AS tackle,
       CASE WHEN ({SERIAL} + nflId) % 5 = 1 THEN 1 ELSE 0 END AS assist,
       CASE WHEN ({SERIAL} + nflId) % 3 = 1 THEN 1 ELSE 0 END AS pff_missedTackle
FROM moves WHERE nflId >= 12 AND frameId = 1"""

RELATIONS["players"] = """
SELECT DISTINCT nflId, (5 + nflId % 2) || '-' || (nflId % 12) AS height, 180 + 5 * nflId AS weight,
       CASE nflId % 3 WHEN 0 THEN 'LB' WHEN 1 THEN 'DB' ELSE 'DL' END AS position, 'Player ' || nflId AS displayName
FROM moves"""

RELATIONS["games"] = """
SELECT DISTINCT gameId, week, CASE WHEN gameId % 2 = 0 THEN 'AAA' ELSE 'BBB' END AS homeTeamAbbr,
       CASE WHEN gameId % 2 = 0 THEN 'BBB' ELSE 'AAA' END AS visitorTeamAbbr
FROM moves"""

RELATIONS["designed"] = """
SELECT * FROM pbp WHERE (pass = 1 OR (rush = 1 AND qb_scramble = 0)) AND sack = 0"""

RELATIONS["standard"] = f"""
SELECT * REPLACE (
    CASE WHEN playDirection = 'left' THEN 120e0 - x ELSE x END - 10e0 AS x,
    CASE WHEN playDirection = 'left' THEN {WIDTH} - y ELSE y END AS y)
FROM tracking"""

RELATIONS["carrier"] = """
SELECT t.gameId, t.playId, t.frameId, t.x AS x_car, t.y AS y_car
FROM standard t JOIN plays p ON t.gameId = p.gameId AND t.playId = p.playId AND t.nflId = p.ballCarrierId"""

RELATIONS["located"] = f"""
SELECT t.*, t.dir * {PI} / 180e0 AS rad_dir, c.x_car, c.y_car,
       sqrt((t.x - c.x_car) ** 2 + (t.y - c.y_car) ** 2) AS distance_to_ball
FROM standard t LEFT JOIN carrier c ON t.gameId = c.gameId AND t.playId = c.playId AND t.frameId = c.frameId
WHERE t.club <> 'football'"""


def scaled(source: str, vmax: str) -> str:
    """Radius, scales and centre on top of a located relation."""
    return f"""
SELECT *, (radio + radio * speed_ratio) / 2 AS scal_x, (radio - radio * speed_ratio) / 2 AS scal_y
FROM (
    SELECT *, CASE WHEN distance_to_ball <= 17 THEN exp(distance_to_ball * 0.1144653e0) + 3
                   WHEN distance_to_ball > 17 THEN 10e0 END AS radio,
           s * s / ({vmax} * {vmax}) AS speed_ratio,
           x - s * sin(rad_dir) AS vector_x, y - s * cos(rad_dir) AS vector_y,
           x - s * sin(rad_dir) * 0.5e0 AS mu_x, y - s * cos(rad_dir) * 0.5e0 AS mu_y
    FROM {source})"""


RELATIONS["scales"] = scaled("located", "15e0")

RELATIONS["clean"] = f"""
SELECT * EXCLUDE (first_row, row_no)
FROM (
    SELECT *, min(CASE WHEN initial THEN row_no END) OVER (PARTITION BY gameId, playId, nflId) AS first_row
    FROM (
        SELECT s.*, d.play_type, s.event IN ({INITIAL}) AS initial,
               row_number() OVER (PARTITION BY s.gameId, s.playId, s.nflId ORDER BY s.frameId) AS row_no
        FROM scales s JOIN designed d ON s.gameId = d.game_id AND s.playId = d.play_id))
WHERE row_no >= first_row"""

RELATIONS["foci"] = """
SELECT *, mu_x - focal * sin(rad_dir) AS f1_1, mu_y - focal * cos(rad_dir) AS f1_2,
       mu_x + focal * sin(rad_dir) AS f2_1, mu_y + focal * cos(rad_dir) AS f2_2
FROM (SELECT *, sqrt((2 * greatest(scal_x, scal_y)) ** 2 - (2 * least(scal_x, scal_y)) ** 2) AS focal FROM clean)"""


def inside(k: str = "5") -> str:
    """Ellipse test of a cell against the foci of the same row."""
    return (
        "sqrt((x - f1_1) ** 2 + (y - f1_2) ** 2) + sqrt((x - f2_1) ** 2 + (y - f2_2) ** 2)"
        f" <= {k} * greatest(scal_x, scal_y)"
    )


# Covariance R S S R' with S = diag(scal_y, scal_x), inverted as a 2x2 matrix.
RELATIONS["influence"] = f"""
WITH boxed AS (
    SELECT gameId AS game, playId AS play, frameId AS frame, nflId AS player, club,
           mu_x, mu_y, rad_dir, scal_x, scal_y, f1_1, f1_2, f2_1, f2_2,
           unnest(range(CAST(greatest(round_even(mu_x, 0) - round_even(5 * scal_x, 0), 0) AS BIGINT),
                        CAST(least(round_even(mu_x, 0) + round_even(5 * scal_x, 0), 120) AS BIGINT) + 1)) AS x
    FROM foci),
cells AS (
    SELECT *, unnest(range(CAST(greatest(round_even(mu_y, 0) - ceil(5 * scal_y), 0) AS BIGINT),
                           CAST(least(round_even(mu_y, 0) + ceil(5 * scal_y), 54) AS BIGINT) + 1)) AS y
    FROM boxed),
held AS (
    SELECT game, play, frame, player, club, x, y, x - mu_x AS dx, y - mu_y AS dy,
           cos(rad_dir) AS c, sin(rad_dir) AS n, scal_y * scal_y AS p, scal_x * scal_x AS q
    FROM cells WHERE {inside()}),
covariance AS (
    SELECT *, c * c * p + n * n * q AS s11, c * n * (q - p) AS s12, n * n * p + c * c * q AS s22 FROM held)
SELECT game, play, frame, player, club, x, y,
       exp(-0.5e0 * (s22 * dx * dx - 2 * s12 * dx * dy + s11 * dy * dy) / (s11 * s22 - s12 * s12)) AS influ
FROM covariance"""

RELATIONS["others"] = """
SELECT i.* FROM influence i
WHERE NOT EXISTS (SELECT 1 FROM plays p
                  WHERE p.gameId = i.game AND p.playId = i.play AND p.ballCarrierId = i.player)"""

RELATIONS["teamsums"] = """
SELECT game, play, frame, x, y, coalesce(sum(influ) FILTER (club = 'BBB'), 0) AS def,
       coalesce(sum(influ) FILTER (club = 'AAA'), 0) AS off
FROM others GROUP BY ALL"""

RELATIONS["lattice"] = """
SELECT xs.x, ys.y FROM (SELECT unnest(range(0, 101)) AS x) xs, (SELECT unnest(range(0, 55)) AS y) ys"""


def completed(sums: str, control: str) -> str:
    """Control of the summed cells, grid completed per frame with a half."""
    return f"""
WITH known AS (SELECT game, play, frame, x, y, {control} AS PC FROM {sums}),
dense AS (SELECT f.*, l.x, l.y FROM (SELECT DISTINCT game, play, frame FROM known) f, lattice l)
SELECT coalesce(k.game, d.game) AS game, coalesce(k.play, d.play) AS play, coalesce(k.frame, d.frame) AS frame,
       coalesce(k.x, d.x) AS x, coalesce(k.y, d.y) AS y, coalesce(k.PC, 0.5e0) AS PC
FROM known k FULL JOIN dense d
  ON k.game = d.game AND k.play = d.play AND k.frame = d.frame AND k.x = d.x AND k.y = d.y"""


RELATIONS["control"] = completed("teamsums", "1 / (1 + exp(off - def))")

RELATIONS["homesums"] = """
SELECT o.game, o.play, o.frame, o.x, o.y, coalesce(sum(o.influ) FILTER (o.club = g.homeTeamAbbr), 0) AS home,
       coalesce(sum(o.influ) FILTER (o.club = g.visitorTeamAbbr), 0) AS away
FROM others o JOIN games g ON o.game = g.gameId GROUP BY ALL"""

RELATIONS["homecontrol"] = completed("homesums", "1 / (1 + exp(away - home))")

RELATIONS["value_cells"] = """
SELECT i.game, i.play, i.frame, i.x, i.y, i.influ AS value
FROM influence i JOIN plays p ON p.gameId = i.game AND p.playId = i.play AND p.ballCarrierId = i.player"""

RELATIONS["near"] = """
SELECT gameId AS game, playId AS play, frameId AS frame, nflId AS player, club AS team
FROM clean WHERE distance_to_ball <= 6"""

RELATIONS["defenders"] = """
SELECT n.* FROM near n JOIN pbp b ON b.game_id = n.game AND b.play_id = n.play AND b.defteam = n.team"""

RELATIONS["close_cells"] = """
SELECT o.* FROM others o JOIN near n
  ON o.game = n.game AND o.play = n.play AND o.frame = n.frame AND o.player = n.player
WHERE o.influ >= 0.01"""

RELATIONS["motion"] = """
SELECT DISTINCT c.gameId, c.playId, c.frameId, c.nflId AS bc_id, c.s AS s_car, c.a AS a_car, c.o AS o_car,
       c.dir AS dir_car, p.gameClock
FROM clean c JOIN plays p ON c.gameId = p.gameId AND c.playId = p.playId AND c.nflId = p.ballCarrierId"""


def followed(only_tacklers: bool) -> str:
    """Tackle frames with the closest approach."""
    condition = "k.tackle IS NOT NULL" if only_tacklers else "true"
    return f"""
SELECT *, CASE WHEN (tackle = 1 OR assist = 1) AND min_dist = 1 THEN 1
               WHEN pff_missedTackle = 1 AND min_dist = 1 THEN 0 END AS action
FROM (
    SELECT c.*, m.bc_id, m.s_car, m.a_car, m.o_car, m.dir_car, m.gameClock, k.tackle, k.assist, k.pff_missedTackle,
           c.playId * 1000 + c.frameId AS play_frame_id,
           CASE WHEN c.distance_to_ball = min(c.distance_to_ball) OVER (PARTITION BY c.gameId, c.playId, c.nflId)
                THEN 1 ELSE 0 END AS min_dist
    FROM clean c
    LEFT JOIN motion m ON c.gameId = m.gameId AND c.playId = m.playId AND c.frameId = m.frameId
    LEFT JOIN tackles k ON c.gameId = k.gameId AND c.playId = k.playId AND c.nflId = k.nflId
    WHERE {condition} AND EXISTS (
        SELECT 1 FROM clean e WHERE e.gameId = c.gameId AND e.playId = c.playId
                                AND e.event IN ('tackle', 'touchdown')))"""


RELATIONS["tacklers"] = followed(True)
RELATIONS["everybody"] = followed(False)


def graded(source: str) -> str:
    """Quality per frame and follower."""
    return f"""
WITH close AS (
    SELECT t.gameId AS game, t.playId AS play, t.frameId AS frame, t.nflId AS tackler, t.min_dist,
           t.distance_to_ball, f.f1_1, f.f1_2, f.f2_1, f.f2_2, f.scal_x, f.scal_y
    FROM {source} t JOIN foci f
      ON t.gameId = f.gameId AND t.playId = f.playId AND t.frameId = f.frameId AND t.nflId = f.nflId
    QUALIFY min(t.distance_to_ball) OVER (PARTITION BY t.gameId, t.playId, t.nflId) <= 5),
products AS (
    SELECT v.game, v.play, v.frame, c.tackler, c.min_dist, c.distance_to_ball, p.PC * v.value AS quality
    FROM value_cells v
    LEFT JOIN control p ON p.game = v.game AND p.play = v.play AND p.frame = v.frame AND p.x = v.x AND p.y = v.y
    JOIN close c ON c.game = v.game AND c.play = v.play AND c.frame = v.frame
    WHERE sqrt((v.x - f1_1) ** 2 + (v.y - f1_2) ** 2) + sqrt((v.x - f2_1) ** 2 + (v.y - f2_2) ** 2)
          <= 5 * greatest(scal_x, scal_y))
SELECT game, play, frame, tackler,
       CASE WHEN count(quality) = count(*) THEN sum(quality) END AS sum_quality,
       CASE WHEN count(quality) = count(*) THEN avg(quality) END AS mean_quality,
       CASE WHEN count(quality) = count(*) THEN median(quality) END AS median_quality,
       CASE WHEN count(quality) = count(*) THEN max(quality) END AS max_quality,
       max(min_dist) AS min_dist, max(distance_to_ball) AS distance
FROM products GROUP BY game, play, frame, tackler"""


RELATIONS["quality"] = graded("tacklers")
RELATIONS["all_quality"] = graded("everybody")

RELATIONS["labels_made"] = """
SELECT gameId AS game, playId AS play, nflId AS tackler, CASE WHEN tackle = 1 OR assist = 1 THEN 1 ELSE 0 END AS tackling
FROM tackles WHERE tackle <> pff_missedTackle OR assist <> pff_missedTackle"""

RELATIONS["contact"] = """
SELECT DISTINCT q.*, l.tackling
FROM (SELECT *, lead(min_dist) OVER (PARTITION BY game, play, tackler ORDER BY frame) AS frame_before FROM quality) q
JOIN labels_made l ON q.game = l.game AND q.play = l.play AND q.tackler = l.tackler
WHERE q.min_dist = 1 AND q.distance <= 8
  AND NOT EXISTS (SELECT 1 FROM pbp b WHERE b.game_id = q.game AND b.play_id = q.play
                                        AND (b.qb_scramble = 1 OR b.fumble = 1))"""


def curve(value: str, intercept: float, slope: float) -> str:
    """Stored logistic curve."""
    return f"(1 / (1 + exp(-({intercept}e0 + {slope}e0 * {value}))))"


BASE = (-1.1180, 0.2277)
CLOGLOG = (-0.64504, 0.09964)
NEW = (-1.2134, 0.2324)

RELATIONS["scored"] = f"SELECT *, {curve('sum_quality', *BASE)} AS p FROM contact"

RELATIONS["grades"] = f"""
SELECT c.tackler, any_value(p.displayName) AS displayName, any_value(p.position) AS position,
       CASE WHEN c.tackler <= 11 THEN 'AAA' ELSE 'BBB' END AS team, 'img/' || c.tackler AS headshot_url,
       avg({curve('c.sum_quality', *NEW)}) AS position_tackle, avg(c.tackling) AS tackle_pct,
       avg(c.tackling) - avg({curve('c.sum_quality', *NEW)}) AS technique, count(*) AS tackles
FROM contact c LEFT JOIN players p ON p.nflId = c.tackler GROUP BY c.tackler"""


def normal_cdf(z: str, terms: int = 60) -> str:
    """Distribution function of the standard normal by its series in odd powers."""
    weights, product = [], 1.0
    for n in range(terms):
        product *= 2 * n + 1
        weights.append(repr(1 / product))
    series = f"list_sum(list_transform([{', '.join(weights)}], lambda c, i: c * ({z}) ** (2 * i - 1)))"
    return f"(0.5e0 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series})"


MEANS = {
    "logit": "1 / (1 + exp(-eta))",
    "probit": normal_cdf("eta"),
    "cloglog": "1 - exp(-exp(eta))",
}
SLOPES = {
    "logit": "mu * (1 - mu)",
    "probit": "exp(-eta * eta / 2) / sqrt(2 * pi())",
    "cloglog": "exp(eta - exp(eta))",
}


def newton_steps(link: str, steps: int, name: str = "fit") -> str:
    """Relations of Fisher scoring for a binomial model on one feature, unrolled; data in
    ``observed``, result in the relation of the last step."""
    mean, slope = MEANS[link], SLOPES[link]
    parts = [f"{name}0 AS (SELECT 0e0 AS b0, 0e0 AS b1)"]
    for i in range(1, steps + 1):
        parts.append(f"""
{name}{i} AS (
    SELECT any_value(b0) + (sum(w * x * x) * sum(u) - sum(w * x) * sum(u * x))
                / (sum(w) * sum(w * x * x) - sum(w * x) ** 2) AS b0,
           any_value(b1) + (sum(w) * sum(u * x) - sum(w * x) * sum(u))
                / (sum(w) * sum(w * x * x) - sum(w * x) ** 2) AS b1
    FROM (SELECT b0, b1, x, g * g / (mu * (1 - mu)) AS w, (y - mu) * g / (mu * (1 - mu)) AS u
          FROM (SELECT *, {slope} AS g
                FROM (SELECT *, {mean} AS mu
                      FROM (SELECT f.b0, f.b1, c.sum_quality AS x, c.tackling AS y, f.b0 + f.b1 * c.sum_quality AS eta
                            FROM observed c, {name}{i - 1} f)))))""")
    return ", ".join(parts)


def newton(link: str, steps: int) -> str:
    """Coefficients of the fit on all contacts."""
    body = newton_steps(link, steps)
    return (
        "SELECT * FROM (WITH observed AS MATERIALIZED (SELECT * FROM contact WHERE sum_quality IS NOT NULL), "
        f"{body} SELECT '{link}' AS link, {r('b0', 3)} AS intercept, {r('b1', 3)} AS slope FROM fit{steps})"
    )


def _needed(sql: str) -> list[str]:
    """Relations a statement mentions, their own needs first."""
    order: list[str] = []

    def visit(text: str, under: tuple[str, ...]) -> None:
        words = set(re.findall(r"[a-z_]+", text))
        for name in RELATIONS:
            if name in words and name not in order and name not in under:
                visit(RELATIONS[name], (*under, name))
                order.append(name)

    visit(sql, ())
    return order


def statement(select: str) -> str:
    """A complete statement."""
    parts = [f"{name} AS MATERIALIZED ({RELATIONS[name]})" for name in _needed(select)]
    if not parts:
        return select
    body = f"SELECT * FROM ({select})" if select.lstrip().startswith("WITH") else select
    return f"WITH {', '.join(parts)} {body}"



def by_frame(source: str, value: str, keys: str = "game, play, frame") -> str:
    """Number of cells and summary of a surface per frame."""
    return (
        f"SELECT {keys}, count(*) AS cells, {r(f'sum({value})')} AS total, {r(f'min({value})')} AS lowest, "
        f"{r(f'max({value})')} AS highest FROM {source} GROUP BY {keys}"
    )


ORACLES: dict[str, str] = {}

CLEAN_VALUES = "x y rad_dir vector_x vector_y x_car y_car distance_to_ball radio speed_ratio scal_x scal_y mu_x mu_y"
QUALITY_VALUES = "sum_quality mean_quality median_quality max_quality"

ORACLES["clean_tracking"] = (
    f"SELECT {KEYS}, club, initial, play_type, {rounded(CLEAN_VALUES)} FROM clean"
)
ORACLES["carrier_track"] = f"SELECT gameId, playId, frameId, {rounded('x_car y_car')} FROM carrier"
ORACLES["carrier_profile"] = f"""
SELECT t.gameId, t.playId, t.frameId, {r('t.x')} AS x_car, {r('t.s')} AS s_car, {r('t.dir')} AS dir_car,
       {r("CAST(split_part(b.height, '-', 1) AS DOUBLE) / 3 + CAST(split_part(b.height, '-', 2) AS DOUBLE) / 36")} AS height_car,
       b.weight AS weight_car, b.position AS position_car, t.displayName AS name_car, p.quarter, p.down, p.gameClock
FROM tracking t JOIN plays p ON t.gameId = p.gameId AND t.playId = p.playId AND t.nflId = p.ballCarrierId
LEFT JOIN players b ON b.nflId = t.nflId"""
ORACLES["ball_track"] = f"""
SELECT t.gameId, t.playId, t.frameId, t.nflId, {r('sqrt((t.x - b.x) ** 2 + (t.y - b.y) ** 2)')} AS distance_to_ball
FROM standard t LEFT JOIN tracking b
  ON b.club = 'football' AND b.gameId = t.gameId AND b.playId = t.playId AND b.frameId = t.frameId
WHERE t.club <> 'football'"""
ORACLES["distance_radius"] = f"SELECT {KEYS}, {rounded('distance_to_ball radio')} FROM scales"
ORACLES["influence_scales_foci"] = (
    f"SELECT {KEYS}, {rounded('scal_x scal_y mu_x mu_y f1_1 f1_2 f2_1 f2_2')} FROM foci"
)
ORACLES["ellipse_axes"] = f"""
SELECT {KEYS}, {r('cos(rad_dir) * scal_y')} AS eigen_v1_1, {r('-sin(rad_dir) * scal_y')} AS eigen_v1_2,
       {r('-sin(rad_dir) * scal_x')} AS eigen_v2_1, {r('-cos(rad_dir) * scal_x')} AS eigen_v2_2 FROM clean"""
ORACLES["raw_velocity"] = f"""
SELECT {KEYS}, {rounded('v_x v_y')},
       {r('CASE WHEN v_x = 0 AND v_y = 0 THEN 0 ELSE atan(v_y / v_x) END')} AS v_theta
FROM (SELECT *, sin(dir * {PI} / 180e0) * s AS v_x, cos(dir * {PI} / 180e0) * s AS v_y
      FROM tracking WHERE club <> 'football')"""
ORACLES["influence_by_frame"] = by_frame("influence", "influ")
ORACLES["influence_by_player"] = by_frame("influence", "influ", "game, play, player")
ORACLES["pitch_control_frame"] = by_frame("control", "PC")
ORACLES["pitch_control_stored"] = ORACLES["pitch_control_frame"]
ORACLES["pitch_control_home_away"] = by_frame("homecontrol", "PC")
ORACLES["home_away_ungrouped"] = f"""
WITH parts AS (
    SELECT i.game, i.play, i.frame, i.x, i.y, coalesce(sum(i.influ) FILTER (i.club = g.homeTeamAbbr), 0) AS home,
           coalesce(sum(i.influ) FILTER (i.club = g.visitorTeamAbbr), 0) AS away
    FROM influence i JOIN games g ON i.game = g.gameId GROUP BY ALL),
surface AS (SELECT game, play, x, y, 1 / (1 + exp(away - home)) AS PC FROM parts)
SELECT game, play, count(*) AS cells, {r('sum(PC)')} AS total, {r('min(PC)')} AS lowest, {r('max(PC)')} AS highest
FROM (SELECT * FROM surface UNION ALL
      SELECT NULL, NULL, l.x, l.y, 0.5e0 FROM lattice l
      WHERE NOT EXISTS (SELECT 1 FROM surface s WHERE s.x = l.x AND s.y = l.y))
GROUP BY game, play"""
ORACLES["complete_grid_counts"] = f"""
SELECT game, play, frame, count(*) AS cells, count(*) FILTER (x <= 100) AS on_grid,
       count(*) FILTER (PC = 0.5e0) AS even FROM control GROUP BY game, play, frame"""
ORACLES["level_bins"] = f"""
SELECT CASE WHEN PC < 0.4e0 THEN 1 WHEN PC < 0.6e0 THEN 2 WHEN PC < 0.8e0 THEN 3 ELSE 4 END AS level, count(*) AS n
FROM control WHERE PC >= 0.2e0 AND PC < 1e0 GROUP BY 1"""
def contours(levels: str) -> str:
    """Segments of the iso-lines, edge by edge: every square whose corners lie on both sides of a
    level is met on two or four of its edges, and pairs of met edges are its segments."""
    return f"""
WITH grid AS (SELECT * FROM control WHERE x BETWEEN 0 AND 100 AND y BETWEEN 0 AND 54),
squares AS (
    SELECT a.game, a.play, a.frame, a.x, a.y, a.PC AS a, b.PC AS b, c.PC AS c, d.PC AS d, level
    FROM grid a
    JOIN grid b ON b.game = a.game AND b.play = a.play AND b.frame = a.frame AND b.x = a.x + 1 AND b.y = a.y
    JOIN grid c ON c.game = a.game AND c.play = a.play AND c.frame = a.frame AND c.x = a.x + 1 AND c.y = a.y + 1
    JOIN grid d ON d.game = a.game AND d.play = a.play AND d.frame = a.frame AND d.x = a.x AND d.y = a.y + 1,
    (VALUES {levels}) AS v(level)
    WHERE least(a.PC, b.PC, c.PC, d.PC) < level AND greatest(a.PC, b.PC, c.PC, d.PC) >= level),
edges AS (
    SELECT *, [
        CASE WHEN (a >= level) <> (b >= level) THEN {{'x': x + (level - a) / (b - a), 'y': y + 0e0}} END,
        CASE WHEN (b >= level) <> (c >= level) THEN {{'x': x + 1e0, 'y': y + (level - b) / (c - b)}} END,
        CASE WHEN (c >= level) <> (d >= level) THEN {{'x': x + (level - d) / (c - d), 'y': y + 1e0}} END,
        CASE WHEN (a >= level) <> (d >= level) THEN {{'x': x + 0e0, 'y': y + (level - a) / (d - a)}} END] AS e,
        (a >= level) = ((a + b + c + d) / 4 >= level) AS apart
    FROM squares),
lines AS (
    SELECT game, play, frame, level, unnest(CASE
        WHEN len(list_filter(e, lambda p: p IS NOT NULL)) = 2 THEN [list_filter(e, lambda p: p IS NOT NULL)]
        WHEN apart THEN [[e[1], e[2]], [e[3], e[4]]] ELSE [[e[1], e[4]], [e[2], e[3]]] END) AS s
    FROM edges)
SELECT game, play, frame, level, count(*) AS segments,
       {r('sum(sqrt((s[2].x - s[1].x) ** 2 + (s[2].y - s[1].y) ** 2))')} AS length, {r('avg(s[1].x + s[2].x)')} AS x
FROM lines GROUP BY game, play, frame, level"""


ORACLES["contour_lines"] = contours("(0.2e0), (0.4e0), (0.6e0), (0.8e0)")
ORACLES["capped_control"] = by_frame(
    "(SELECT game, play, frame, x, y, least(sum(influ), 1) AS PC FROM close_cells GROUP BY ALL)", "PC"
)
ORACLES["individual_control"] = by_frame(
    """(SELECT d.game, d.play, d.frame, d.player AS defender, c.x, c.y, least(sum(c.influ), 1) AS PC
        FROM defenders d JOIN close_cells c ON c.game = d.game AND c.play = d.play AND c.frame = d.frame
         AND (c.player = d.player OR c.club <> d.team) GROUP BY ALL)""",
    "PC",
    "game, play, frame, defender",
)
ORACLES["value_map_frame"] = by_frame("value_cells", "value")
ORACLES["value_map_stored"] = ORACLES["value_map_frame"]
ORACLES["near_defenders"] = "SELECT game, play, frame, player, team FROM defenders"
ORACLES["tackle_frames"] = f"""
SELECT {KEYS}, bc_id, {rounded('s_car a_car o_car dir_car')}, gameClock, tackle, assist, pff_missedTackle,
       play_frame_id, min_dist, action FROM tacklers"""
ORACLES["tackle_frames_all"] = f"SELECT {KEYS}, tackle, min_dist, action FROM everybody"
ORACLES["tackle_frames_by_event"] = f"""
WITH joined AS (
    SELECT t.*, k.tackle, k.assist, k.pff_missedTackle,
           t.event IN ('run', 'lateral', 'pass_outcome_caught') AS initial,
           row_number() OVER (PARTITION BY t.gameId, t.playId, t.nflId ORDER BY t.frameId) AS row_no
    FROM tracking t JOIN designed d ON t.gameId = d.game_id AND t.playId = d.play_id
    LEFT JOIN tackles k ON t.gameId = k.gameId AND t.playId = k.playId AND t.nflId = k.nflId),
trimmed AS (
    SELECT * FROM joined
    QUALIFY row_no >= min(CASE WHEN initial THEN row_no END) OVER (PARTITION BY gameId, playId, nflId)),
spots AS (
    SELECT t.gameId, t.playId, t.frameId, t.x AS x_car, t.y AS y_car FROM tracking t JOIN plays p
      ON t.gameId = p.gameId AND t.playId = p.playId AND t.nflId = p.ballCarrierId),
measured AS (
    SELECT t.*, sqrt((t.x - c.x_car) ** 2 + (t.y - c.y_car) ** 2) AS distance_to_carrier
    FROM trimmed t LEFT JOIN spots c ON t.gameId = c.gameId AND t.playId = c.playId AND t.frameId = c.frameId
    WHERE t.club <> 'football'),
flagged AS (
    SELECT *, CASE WHEN distance_to_carrier = min(distance_to_carrier) OVER (PARTITION BY gameId, playId, nflId)
                   THEN 1 ELSE 0 END AS min_dist FROM measured)
SELECT {KEYS}, {r('distance_to_carrier')} AS distance_to_carrier, min_dist,
       CASE WHEN event = 'tackle' AND (tackle = 1 OR assist = 1) THEN 1
            WHEN pff_missedTackle = 1 AND min_dist = 1 THEN 0 END AS action FROM flagged"""
ORACLES["first_initial_trim"] = """
SELECT gameId, playId, nflId, count(*) AS frames, min(frameId) AS first_frame, max(frameId) AS last_frame
FROM (SELECT *, min(CASE WHEN event IN ('handoff', 'run', 'lateral', 'pass_outcome_caught') THEN frameId END)
                  OVER (PARTITION BY gameId, playId, nflId) AS start FROM tracking)
WHERE frameId >= start GROUP BY gameId, playId, nflId"""
ORACLES["until_tackle_trim"] = f"""
WITH numbered AS (
    SELECT t.*, row_number() OVER (PARTITION BY t.gameId, t.playId, t.nflId ORDER BY t.frameId) AS row_no
    FROM tracking t JOIN designed d ON t.gameId = d.game_id AND t.playId = d.play_id),
kept AS (
    SELECT * FROM numbered
    QUALIFY row_no >= min(CASE WHEN event IN ('pass_arrived', 'handoff', 'run', 'lateral') THEN row_no END)
                        OVER (PARTITION BY gameId, playId, nflId)
        AND row_no <= coalesce(min(CASE WHEN event = 'tackle' THEN row_no END)
                        OVER (PARTITION BY gameId, playId, nflId) + 1, row_no)),
placed AS (
    SELECT k.* EXCLUDE (x, y), t.x, t.y, k.dir * {PI} / 180e0 AS rad_dir,
           sqrt((t.x - b.x) ** 2 + (t.y - b.y) ** 2) AS distance_to_ball
    FROM kept k
    JOIN standard t ON t.gameId = k.gameId AND t.playId = k.playId AND t.frameId = k.frameId
                   AND t.nflId IS NOT DISTINCT FROM k.nflId
    LEFT JOIN tracking b ON b.club = 'football' AND b.gameId = k.gameId AND b.playId = k.playId
                        AND b.frameId = k.frameId)
SELECT {KEYS}, {rounded('distance_to_ball scal_x scal_y mu_x mu_y')} FROM ({scaled('placed', '13.6e0')})"""
ORACLES["min_dist_flag"] = f"""
SELECT {KEYS}, CASE WHEN distance_to_ball = min(distance_to_ball) OVER (PARTITION BY gameId, playId, nflId)
                    THEN 1 ELSE 0 END AS min_dist FROM clean"""
ORACLES["cumulative_distance_play"] = f"""
SELECT {KEYS}, {r('sum(dis) OVER (PARTITION BY gameId, playId, nflId ORDER BY frameId)')} AS traveled_play
FROM tracking WHERE club <> 'football'"""
ORACLES["cumulative_distance_game"] = f"""
SELECT {KEYS}, {r('sum(dis) OVER (PARTITION BY gameId, nflId ORDER BY playId * 1000 + frameId)')} AS traveled_game
FROM tracking WHERE club <> 'football'"""
ORACLES["quality_summary"] = (
    f"SELECT game, play, frame, tackler, {rounded(QUALITY_VALUES)}, min_dist, {r('distance')} AS distance FROM quality"
)
ORACLES["quality_stored"] = ORACLES["quality_summary"]
ORACLES["quality_by_frame"] = ORACLES["quality_summary"]
ORACLES["quality_strips"] = ORACLES["quality_summary"]
ORACLES["quality_all_players"] = (
    f"SELECT game, play, frame, tackler, {rounded(QUALITY_VALUES)}, min_dist, {r('distance')} AS distance FROM all_quality"
)
ORACLES["frame_tackle_prob"] = f"""
WITH ellipses AS (
    SELECT t.gameId AS game, t.playId AS play, t.frameId AS frame, t.nflId AS tackler,
           f.f1_1, f.f1_2, f.f2_1, f.f2_2, f.scal_x, f.scal_y
    FROM tacklers t JOIN foci f
      ON t.gameId = f.gameId AND t.playId = f.playId AND t.frameId = f.frameId AND t.nflId = f.nflId
    QUALIFY min(t.distance_to_ball) OVER (PARTITION BY t.gameId, t.playId, t.nflId) <= 5),
area AS (
    SELECT e.*, p.x, p.y, p.PC * v.value AS product
    FROM value_cells v
    LEFT JOIN control p ON p.game = v.game AND p.play = v.play AND p.frame = v.frame AND p.x = v.x AND p.y = v.y
    JOIN ellipses e ON e.game = v.game AND e.play = v.play AND e.frame = v.frame
    WHERE sqrt((v.x - f1_1) ** 2 + (v.y - f1_2) ** 2) + sqrt((v.x - f2_1) ** 2 + (v.y - f2_2) ** 2)
          <= 4 * greatest(scal_x, scal_y))
SELECT game, play, frame, tackler, {r('CASE WHEN count(product) = count(*) THEN sum(product) END')} AS prob
FROM area GROUP BY game, play, frame, tackler"""
ORACLES["frame_before_lead"] = """
SELECT game, play, frame, tackler, min_dist,
       lead(min_dist) OVER (PARTITION BY game, play, tackler ORDER BY frame) AS frame_before FROM quality"""
ORACLES["contact_set"] = f"""
SELECT game, play, frame, tackler, {r('sum_quality')} AS sum_quality, {r('distance')} AS distance, min_dist,
       frame_before, tackling FROM contact"""
ORACLES["tackle_probability"] = f"""
SELECT game, play, frame, tackler, {r(curve('sum_quality', *BASE))} AS base,
       {r(curve('sum_quality', *CLOGLOG))} AS cloglog, {r(curve('sum_quality', *NEW))} AS new FROM quality"""
ORACLES["play_probability"] = f"""
SELECT game, play, frame, {r('best')} AS max_sum, {r(curve('best', *BASE))} AS probability,
       'Tackle Probability: ' || regexp_replace(CAST(round_even(round_even({curve('best', *BASE)}, 3) * 100, 1) AS VARCHAR),
                                                '\\.0$', '') || '%' AS label
FROM (SELECT game, play, frame, CASE WHEN count(sum_quality) = count(*) THEN max(sum_quality) END AS best
      FROM quality GROUP BY game, play, frame)"""
ORACLES["player_grades"] = (
    "SELECT tackler, displayName, position, team, headshot_url, "
    f"{rounded('position_tackle tackle_pct technique')}, tackles FROM grades"
)


def ranked(order: str, condition: str, k: int) -> str:
    """First rows of the grades."""
    return (
        "SELECT displayName, position, round_even(100 * position_tackle, 1) AS position_tackle, "
        "round_even(100 * tackle_pct, 1) AS tackle_pct, round_even(100 * technique, 1) AS technique, tackles "
        f"FROM grades WHERE {condition} ORDER BY {order}, displayName LIMIT {k}"
    )


ORACLES["leaderboard_positioning"] = ranked("grades.position_tackle DESC", "tackles >= 3 AND position = 'LB'", 5)
ORACLES["leaderboard_top"] = ranked("grades.technique DESC", "tackles >= 3 AND position = 'DB'", 10)
ORACLES["leaderboard_bottom"] = ranked("grades.technique ASC", "tackles >= 3 AND position = 'DL'", 10)
ORACLES["leaderboard_each_position"] = """
SELECT displayName, position, place, tackles
FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY technique DESC, displayName) AS place
      FROM grades WHERE tackles >= 3) WHERE place <= 2"""
ORACLES["first_events"] = """
SELECT DISTINCT first FROM (
    SELECT gameId, playId, event AS first FROM clean WHERE event IS NOT NULL AND event <> 'ball_snap' AND event <> 'lateral'
    QUALIFY row_number() OVER (PARTITION BY gameId, playId ORDER BY nflId, frameId) = 1)"""
ORACLES["play_length"] = (
    "SELECT gameId, playId, count(DISTINCT frameId) AS frames FROM tracking GROUP BY gameId, playId"
)
ORACLES["mean_by"] = (
    f"SELECT tackling, {r('avg(sum_quality)')} AS mean_sum_quality FROM contact GROUP BY tackling"
)
ORACLES["histogram_quality"] = f"""
SELECT tackling, bin, {r('bin * 0.7e0')} AS centre, n, {r('n / (sum(n) OVER (PARTITION BY tackling) * 0.7e0)')} AS density
FROM (SELECT tackling, {whole('ceil((sum_quality - 0.35e0) / 0.7e0)')} AS bin, count(*) AS n
      FROM contact WHERE sum_quality IS NOT NULL GROUP BY 1, 2)"""
ORACLES["histogram_default_bins"] = f"""
WITH span AS (SELECT min(distance_to_ball) AS lo, (max(distance_to_ball) - min(distance_to_ball)) / 29 AS w FROM clean)
SELECT bin, {r('any_value(lo) + (bin - 1) * any_value(w)')} AS centre, count(*) AS n,
       {r('count(*) / (sum(count(*)) OVER () * any_value(w))')} AS density
FROM (SELECT {whole('ceil((distance_to_ball - lo + w / 2) / w)')} AS bin, lo, w FROM clean, span
      WHERE distance_to_ball IS NOT NULL)
GROUP BY bin"""
ORACLES["box_stats"] = f"""
WITH q AS (
    SELECT play_type, count(distance_to_ball) AS n, quantile_cont(distance_to_ball, 0.25) AS q1,
           quantile_cont(distance_to_ball, 0.5) AS median, quantile_cont(distance_to_ball, 0.75) AS q3
    FROM clean GROUP BY play_type)
SELECT c.play_type, n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
       {r('min(c.distance_to_ball) FILTER (c.distance_to_ball >= q1 - 1.5 * (q3 - q1))')} AS low,
       {r('max(c.distance_to_ball) FILTER (c.distance_to_ball <= q3 + 1.5 * (q3 - q1))')} AS high,
       count(*) FILTER (c.distance_to_ball < q1 - 1.5 * (q3 - q1) OR c.distance_to_ball > q3 + 1.5 * (q3 - q1)) AS outliers
FROM clean c JOIN q ON c.play_type = q.play_type WHERE c.distance_to_ball IS NOT NULL
GROUP BY c.play_type, n, q1, median, q3"""
ORACLES["qq_uniform"] = f"""
SELECT play_type, {r('s', 2)} AS speed, count(*) AS n, {r('(min(k) - 0.5) / any_value(total)', 6)} AS first,
       {r('(max(k) - 0.5) / any_value(total)', 6)} AS last
FROM (SELECT play_type, s, row_number() OVER (PARTITION BY play_type ORDER BY s) AS k,
             count(*) OVER (PARTITION BY play_type) AS total FROM clean)
GROUP BY play_type, s"""
ORACLES["qq_uniform_grid"] = f"""
SELECT i, {r('(i - 0.5e0) / 50')} AS uniform, n
FROM (SELECT unnest(range(1, 51)) AS i), (SELECT count(*) AS n FROM tracking WHERE club <> 'football' AND (week <> 1 OR s < 5))"""
ORACLES["confusion_matrix"] = f"""
SELECT tp, fp, fn, tn, {r('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {r('tp / (tp + fn)')} AS sensitivity,
       {r('tn / (tn + fp)')} AS specificity
FROM (SELECT count(*) FILTER (p >= 0.5 AND tackling = 1) AS tp, count(*) FILTER (p >= 0.5 AND tackling = 0) AS fp,
             count(*) FILTER (p < 0.5 AND tackling = 1) AS fn, count(*) FILTER (p < 0.5 AND tackling = 0) AS tn
      FROM scored)"""
ORACLES["log_loss"] = f"SELECT {r('avg(-(tackling * ln(p) + (1 - tackling) * ln(1 - p)))')} AS log_loss FROM scored"
ORACLES["calibration_bins"] = f"""
SELECT bin, count(*) FILTER (tackling = 1) AS successes, count(*) FILTER (tackling = 0) AS misses,
       {r('(bin + 0.5) * 0.7e0')} AS centre, {r('avg(tackling)')} AS observed,
       {r(curve('((bin + 0.5) * 0.7e0)', *NEW))} AS expected
FROM (SELECT *, {whole('floor(sum_quality / 0.7e0)')} AS bin FROM contact WHERE sum_quality BETWEEN 0 AND 21)
GROUP BY bin"""
ORACLES["field_lines"] = """
SELECT gameId, playId, playDirection, los AS line_of_scrimmage,
       CASE WHEN playDirection = 'left' THEN los - yardsToGo ELSE los + yardsToGo END AS to_go_line
FROM (SELECT p.*, d.playDirection,
             CASE WHEN d.playDirection = 'left' THEN yardlineNumber + 10 ELSE 110 - yardlineNumber END AS los
      FROM plays p JOIN (SELECT DISTINCT gameId, playId, playDirection FROM tracking) d
        ON p.gameId = d.gameId AND p.playId = d.playId)"""
ORACLES["team_colors"] = """
SELECT gameId, homeTeamAbbr, visitorTeamAbbr, 'first ' || homeTeamAbbr AS home_1, 'second ' || homeTeamAbbr AS home_2,
       'second ' || visitorTeamAbbr AS away_1, 'first ' || visitorTeamAbbr AS away_2 FROM games"""
ORACLES["parse_height"] = f"""
SELECT nflId, {r("CAST(split_part(height, '-', 1) AS DOUBLE) / 3 + CAST(split_part(height, '-', 2) AS DOUBLE) / 36")} AS height,
       weight, position, displayName FROM players"""
ORACLES["team_sides"] = """
SELECT gameId AS game, playId AS play, possessionTeam AS club, 'off' AS team FROM plays
UNION ALL SELECT gameId, playId, defensiveTeam, 'def' FROM plays"""
ORACLES["week_sides"] = """
SELECT g.gameId, c.nflId, CASE WHEN c.club = g.homeTeamAbbr THEN 'home' ELSE 'away' END AS club, c.club AS team
FROM games g JOIN (SELECT DISTINCT gameId, nflId, club FROM tracking WHERE club <> 'football') c ON c.gameId = g.gameId"""
ORACLES["designed_plays"] = "SELECT game_id, play_id, pass, rush, sack, qb_scramble, play_type FROM designed"
ORACLES["broken_plays_anti"] = (
    "SELECT game_id, play_id FROM pbp WHERE NOT (qb_scramble = 1 OR fumble = 1)"
)
ORACLES["signal_export"] = f"""
SELECT user_id % 90 * 1e0 AS client_latitude, event_id % 180 * 1e0 AS client_longitude,
       event_type AS network_operator_name, {r('-value')} AS rsrp
FROM events WHERE -value BETWEEN -121 AND -44 AND event_type = 'view'"""
ORACLES["signal_by_operator"] = f"""
SELECT event_type AS network_operator_name, count(*) AS n, {r('avg(-value)')} AS mean_rsrp
FROM events WHERE -value BETWEEN -121 AND -44 GROUP BY event_type"""
ORACLES["game_buckets"] = f"""
SELECT week, gameId AS game,
       {whole('ceil(4 * row_number() OVER (PARTITION BY week ORDER BY gameId) / count(*) OVER (PARTITION BY week)) - 1')} AS bucket
FROM games"""
ORACLES["find_frames"] = f"""
SELECT {KEYS}, {rounded('s rad_dir')} FROM clean WHERE distance_to_ball = 0 AND s >= 5 AND rad_dir BETWEEN 2.3e0 AND 3.5e0"""
ORACLES["pc_training_set"] = f"""
SELECT c.game, c.play, c.frame, count(*) AS cells, {r('sum(c.PC)')} AS total, {r('avg(t.x)')} AS x_car, {r('avg(t.y)')} AS y_car
FROM control c JOIN plays p ON p.gameId = c.game AND p.playId = c.play
LEFT JOIN tracking t ON t.gameId = c.game AND t.playId = c.play AND t.frameId = c.frame AND t.nflId = p.ballCarrierId
WHERE c.PC >= 0.1 GROUP BY c.game, c.play, c.frame"""
ORACLES["tracking_files"] = f"""
SELECT week, count(*) AS n, count(DISTINCT gameId) AS games, {r('sum(x)')} AS x FROM tracking GROUP BY week"""
ORACLES["season_files"] = f"""
SELECT 'plays' AS name, count(*) AS n, {whole('sum(yardsToGo)')} AS total FROM plays
UNION ALL SELECT 'tackles', count(*), {whole('sum(tackle + assist)')} FROM tackles
UNION ALL SELECT 'players', count(*), {whole('sum(weight)')} FROM players
UNION ALL SELECT 'games', count(*), {whole('sum(week)')} FROM games"""
ORACLES["pbp_file"] = f"""
SELECT play_type, count(*) AS n, {whole('sum(sack)')} AS sacks, count(DISTINCT game_id) AS games FROM pbp GROUP BY play_type"""
ORACLES["roster_file"] = """
SELECT CAST(nflId AS VARCHAR) AS gsis_it_id, position, CASE WHEN nflId <= 11 THEN 'AAA' ELSE 'BBB' END AS team,
       'img/' || nflId AS headshot_url
FROM players"""
ORACLES["color_file"] = """
SELECT DISTINCT club AS teams, 'first ' || club AS color1, 'second ' || club AS color2, 'red' AS color1_family
FROM tracking WHERE club <> 'football'"""
ORACLES["play_columns"] = "SELECT gameId, playId, ballCarrierId, quarter, yardsToGo FROM plays"
ORACLES["zeroed_players"] = f"""
SELECT week, {whole('sum(coalesce(nflId, 0))')} AS ids, count(*) FILTER (nflId IS NULL) AS balls FROM tracking GROUP BY week"""
ORACLES["stage_files"] = f"""
SELECT t.week, b.bucket, count(*) AS n, count(DISTINCT t.gameId) AS games, {r('sum(t.x)')} AS x
FROM tracking t JOIN ({ORACLES["game_buckets"]}) b ON b.game = t.gameId AND b.week = t.week GROUP BY t.week, b.bucket"""
ORACLES["play_lookup"] = f"""
SELECT c.gameId, c.playId, count(*) AS n, count(DISTINCT c.frameId) AS frames, {r('sum(c.x)')} AS x
FROM clean c JOIN (SELECT DISTINCT gameId, playId FROM tracking WHERE event = 'touchdown') w
  ON c.gameId = w.gameId AND c.playId = w.playId
GROUP BY c.gameId, c.playId"""
ORACLES["replaced_week"] = f"""
SELECT k AS snapshot, week, count(*) AS n, {r('sum(s)')} AS s
FROM tracking, (VALUES (1), (2)) AS v(k)
WHERE k = 1 OR week <> 1 OR s < 5
GROUP BY k, week"""
ORACLES["signal_files"] = f"""
SELECT count(*) AS n, {r('sum(-value)')} AS rsrp, {r('sum(user_id % 90 * 1e0)')} AS latitude
FROM events WHERE -value BETWEEN -121 AND -44 AND event_type = 'view'"""
ORACLES["stratified_split"] = f"""
SELECT tackling, count(*) AS n, {whole('ceil(0.75e0 * count(*))')} AS n_train FROM contact GROUP BY tackling"""
def key_hash(keys: str, seed: int = 12) -> str:
    """60 bits of the MD5 of some keys and the seed."""
    parts = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in [*keys.split(), f"'{seed}'"])
    return f"CAST('0x' || md5({parts})[1:15] AS BIGINT)"


ORACLES["pc_split_groups"] = f"""
SELECT * FROM (WITH located AS MATERIALIZED (
    SELECT c.*, {key_hash('c.game c.play c.frame c.x c.y')} AS h
    FROM control c JOIN plays p ON p.gameId = c.game AND p.playId = c.play
    JOIN tracking t ON t.gameId = c.game AND t.playId = c.play AND t.frameId = c.frame AND t.nflId = p.ballCarrierId
    WHERE c.PC >= 0.1 AND t.x IS NOT NULL),
bounds AS (SELECT quantile_cont(PC, [0.25, 0.5, 0.75]) AS q FROM located),
ranked AS (
    SELECT x, y, PC, row_number() OVER (PARTITION BY stratum ORDER BY h) AS k, count(*) OVER (PARTITION BY stratum) AS n
    FROM (SELECT *, CAST(q[1] < PC AS INT) + CAST(q[2] < PC AS INT) + CAST(q[3] < PC AS INT) AS stratum FROM located, bounds))
SELECT k <= ceil(0.8e0 * n) AS is_train, count(*) AS n, {r('sum(PC)')} AS total, {whole('sum(x * y)')} AS places
FROM ranked GROUP BY 1)"""

STEPS = {"logit": 8, "probit": 10, "cloglog": 12}


def evaluation() -> str:
    """Every link fitted on the training part and judged on the rest, in both forms."""
    fits = ", ".join(newton_steps(link, n, f"{link}_") for link, n in STEPS.items())
    held = " UNION ALL ".join(
        f"SELECT '{link}' AS link, {form} AS logistic_link, tackling AS y, "
        f"{MEANS['logit'] if form else MEANS[link]} AS p FROM (SELECT s.tackling, f.b0 + f.b1 * s.sum_quality AS eta "
        f"FROM split s, {link}_{n} f WHERE NOT s.is_train AND s.sum_quality IS NOT NULL)"
        for link, n in STEPS.items()
        for form in (False, True)
    )
    return f"""
SELECT * FROM (WITH split AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY tackling ORDER BY {key_hash('game play frame tackler')})
              <= ceil(0.75e0 * count(*) OVER (PARTITION BY tackling)) AS is_train FROM contact),
observed AS MATERIALIZED (SELECT * FROM split WHERE is_train AND sum_quality IS NOT NULL AND tackling IS NOT NULL),
{fits}, held AS ({held})
SELECT link, logistic_link, tp, fp, fn, tn, {r('(tp + tn) / (tp + tn + fp + fn)', 3)} AS accuracy, {r('loss', 3)} AS log_loss
FROM (SELECT link, logistic_link,
             count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp,
             count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn,
             avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))) AS loss
      FROM held GROUP BY link, logistic_link))"""


ORACLES["model_evaluation"] = evaluation()
ORACLES["pc_regressor"] = f"""
SELECT * FROM (WITH located AS MATERIALIZED (
    SELECT c.PC, row_number() OVER (ORDER BY {key_hash('c.game c.play c.frame c.x c.y')}) AS k, count(*) OVER () AS n
    FROM control c JOIN plays p ON p.gameId = c.game AND p.playId = c.play
    JOIN tracking t ON t.gameId = c.game AND t.playId = c.play AND t.frameId = c.frame AND t.nflId = p.ballCarrierId
    WHERE c.PC >= 0.1 AND t.x IS NOT NULL),
middle AS (SELECT avg(PC) AS m FROM located WHERE k <= ceil(0.8e0 * n))
SELECT count(*) FILTER (k <= ceil(0.8e0 * n)) AS n_train, count(*) FILTER (k > ceil(0.8e0 * n)) AS n_held_out,
       count(*) FILTER (k > ceil(0.8e0 * n)) AS n_scored,
       {r('avg((PC - m) ** 2) FILTER (k > ceil(0.8e0 * n))')} AS mean_mse, true AS better
FROM located, middle)"""
ORACLES["glm_probit"] = newton("probit", 10)
ORACLES["glm_logit"] = newton("logit", 8)
ORACLES["glm_saved"] = ORACLES["glm_logit"]
ORACLES["glm_cloglog"] = newton("cloglog", 12)


def oracle_sql() -> dict[str, str]:
    """Name to complete statement."""
    return {name: statement(select) for name, select in ORACLES.items()}
