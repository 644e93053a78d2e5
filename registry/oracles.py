"""The same results in SQL, by another method wherever there is one.

Chains and X01 are recursive here and folds there, Cricket compares closing
times here and uses running sums there, calibrations are inverted here and
fitted there, ticket texts are built here and parsed there.
"""

from __future__ import annotations

PARTS: dict[str, str] = {}

PARTS["ev"] = """
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         user_id // 2 AS pair,
         's' || CAST(user_id // 2 AS VARCHAR) AS session_id,
         'p' || CAST(user_id AS VARCHAR) AS player_id,
         'c' || CAST(user_id AS VARCHAR) AS calibration_id,
         ((event_id * 7919) % 2001 - 1000) * 0.0011e0 AS x,
         ((event_id * 104729) % 2003 - 1001) * 0.0011e0 AS y
  FROM events"""

PARTS["polar"] = """
  SELECT *, sqrt(x * x + y * y) * 170e0 AS mm,
         [20, 1, 18, 4, 13, 6, 10, 15, 2, 17, 3, 19, 7, 16, 8, 11, 14, 9, 12, 5][
           1 + CAST(floor((degrees(atan2(x, y)) + CASE WHEN degrees(atan2(x, y)) < -9e0
             THEN 369e0 ELSE 9e0 END) / 18e0) AS INTEGER) % 20] AS wedge
  FROM ev"""

PARTS["hit"] = """
  SELECT * , CAST(segment * multiplier AS INTEGER) AS score,
         CASE WHEN segment = 0 THEN 'MISS' WHEN segment = 25 AND multiplier = 1 THEN 'SB'
              WHEN segment = 25 THEN 'DB'
              ELSE ['S', 'D', 'T'][multiplier] || CAST(segment AS VARCHAR) END AS notation
  FROM (SELECT *,
          CAST(CASE WHEN mm < 15.9e0 THEN 25 WHEN mm < 170e0 THEN wedge ELSE 0 END AS INTEGER)
            AS segment,
          CAST(CASE WHEN mm < 6.35e0 THEN 2 WHEN mm < 15.9e0 THEN 1 WHEN mm < 99e0 THEN 1
               WHEN mm < 107e0 THEN 3 WHEN mm < 162e0 THEN 1 WHEN mm < 170e0 THEN 2
               ELSE 0 END AS INTEGER) AS multiplier
        FROM polar)"""

PARTS["thr"] = """
  SELECT event_id, pair, CAST(event_id AS VARCHAR) AS id, session_id, player_id,
         ts AS captured_at, x, y, segment, multiplier, score, notation, k / 100e0 AS confidence,
         calibration_id,
         CASE WHEN event_type = 'error' THEN 'manual-correction' ELSE 'camera' END AS source,
         CASE WHEN event_type <> 'error' THEN NULL WHEN k >= 95 THEN 'lost-' || event_id
              ELSE CAST(event_id - 1 - k % 3 AS VARCHAR) END AS correction_of
  FROM hit"""

PARTS["dirty_once"] = """
  SELECT * REPLACE (
           CASE WHEN event_id % 97 = 0 THEN score + 1 ELSE score END AS score,
           CASE WHEN event_id % 101 = 0 THEN confidence + 1 ELSE confidence END AS confidence,
           CASE WHEN event_id % 103 = 0 THEN 'other' ELSE source END AS source)
  FROM thr"""

PARTS["dirty"] = """
  SELECT * EXCLUDE (copies) FROM
    (SELECT *, unnest(generate_series(1, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END)) AS copies
     FROM dirty_once)"""

PARTS["broken"] = """
  SELECT event_id, segment AS seg0, multiplier AS mult0,
         CASE WHEN event_id % 139 = 0 THEN 21 ELSE segment END AS seg,
         CASE WHEN event_id % 149 = 0 THEN 4 ELSE multiplier END AS mult,
         CASE WHEN event_id % 97 = 0 THEN score + 1 ELSE score END AS score,
         CASE WHEN event_id % 101 = 0 THEN confidence + 1 ELSE confidence END AS confidence,
         CASE WHEN event_id % 103 = 0 THEN 'other' ELSE source END AS source,
         (correction_of IS NOT NULL) <> (event_id % 163 = 0) AS corrects
  FROM thr"""

PARTS["faults"] = """
  SELECT event_id, concat_ws(',',
    CASE WHEN event_id % 113 = 0 THEN 'id' END,
    CASE WHEN event_id % 127 = 0 THEN 'session_id' END,
    CASE WHEN event_id % 131 = 0 THEN 'captured_at' END,
    CASE WHEN event_id % 137 = 0 THEN 'impact' END,
    CASE WHEN seg = 21 THEN 'segment' END,
    CASE WHEN mult = 4 OR seg = 21 THEN 'multiplier' END,
    CASE WHEN score <> seg * mult THEN 'score' END,
    CASE WHEN event_id % 151 = 0 OR seg <> seg0 OR mult <> mult0 THEN 'notation' END,
    CASE WHEN confidence > 1 OR confidence < 0 THEN 'confidence' END,
    CASE WHEN event_id % 157 = 0 THEN 'calibration_id' END,
    CASE WHEN source = 'other' THEN 'source' END,
    CASE WHEN (source = 'manual-correction') <> corrects THEN 'correction_of' END) AS violations
  FROM broken"""

PARTS["cal"] = """
  SELECT s_suppkey, 'c' || CAST(s_suppkey AS VARCHAR) AS calibration_id,
         's' || CAST(s_suppkey // 2 AS VARCHAR) AS session_id,
         CASE WHEN s_suppkey % 10 < 8
              THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey * 37 % 29 AS INTEGER)) END
           AS validated_at,
         CAST(s_suppkey % 10 AS DOUBLE) AS i
  FROM supplier"""

PARTS["det"] = """
  SELECT event_id, CAST(event_id AS VARCHAR) AS throw_id, view, event_id * 3 + view AS frame_no,
         session_id, player_id, ts AS captured_at, calibration_id, x + (view - 1) * 0.002e0 AS bx, y AS by0,
         ((k + 31 * view) % 100 + 1) / 101e0 AS confidence
  FROM ev, (SELECT unnest([0, 1, 2]) AS view)"""

PARTS["game"] = """
  SELECT session_id, CASE WHEN pair % 2 = 0 THEN 'X01' ELSE 'Cricket' END AS game_type,
         CAST(CASE pair % 3 WHEN 0 THEN 301 WHEN 1 THEN 501 ELSE 701 END AS INTEGER)
           AS start_score,
         pair % 5 <> 0 AS double_out,
         unnest([first_at, TIMESTAMP '2024-01-16']) AS started_at
  FROM (SELECT session_id, pair, min(ts) AS first_at FROM ev GROUP BY ALL)"""

PARTS["winner"] = """
  SELECT id, correction_of AS parent FROM
    (SELECT *, row_number() OVER (PARTITION BY correction_of
                                  ORDER BY captured_at DESC, id DESC) AS n
     FROM thr WHERE correction_of IS NOT NULL)
  WHERE n = 1"""

PARTS["chain"] = """
  SELECT parent AS root, id, 1 AS step FROM winner
  WHERE parent NOT IN (SELECT id FROM winner)
  UNION ALL
  SELECT c.root, w.id, c.step + 1 FROM chain c JOIN winner w ON w.parent = c.id"""

PARTS["ends"] = """
  SELECT c.root, c.id AS final_id, CAST(c.step AS BIGINT) AS n_steps,
         CASE WHEN t.id IS NULL THEN 'orphan' WHEN t.correction_of IS NOT NULL THEN 'superseded'
              ELSE 'resolved' END AS status
  FROM chain c LEFT JOIN thr t ON t.id = c.root
  WHERE c.id NOT IN (SELECT parent FROM winner)"""

PARTS["eff"] = """
  SELECT o.id, o.session_id, o.player_id, o.captured_at, coalesce(f.id, o.id) AS final_id,
         coalesce(f.x, o.x) AS x, coalesce(f.y, o.y) AS y,
         coalesce(f.segment, o.segment) AS segment,
         coalesce(f.multiplier, o.multiplier) AS multiplier,
         coalesce(f.score, o.score) AS score, coalesce(f.notation, o.notation) AS notation,
         coalesce(f.confidence, o.confidence) AS confidence
  FROM thr o LEFT JOIN ends e ON e.root = o.id AND e.status = 'resolved'
  LEFT JOIN thr f ON f.id = e.final_id
  WHERE o.correction_of IS NULL"""

PARTS["pairs"] = """
  SELECT o.id, e.final_id, o.session_id, o.confidence, o.segment AS detected_segment,
         e.segment AS corrected_segment, o.score AS detected_score, e.score AS corrected_score,
         sqrt(pow(o.x - e.x, 2) + pow(o.y - e.y, 2)) AS distance,
         o.segment = e.segment AND o.multiplier = e.multiplier AS agree
  FROM thr o JOIN eff e ON e.id = o.id"""

PARTS["numbered"] = """
  SELECT *, row_number() OVER (PARTITION BY session_id, player_id
                               ORDER BY captured_at, id) - 1 AS n
  FROM eff"""

PARTS["turns"] = """
  SELECT *, n // 3 AS turn_no, CAST(n % 3 + 1 AS INTEGER) AS dart_no FROM numbered"""

PARTS["x01_dart"] = """
  SELECT t.id, t.session_id, t.player_id, g.started_at, t.captured_at, g.start_score,
         g.double_out, t.score, t.multiplier = 2 AS dbl,
         row_number() OVER (PARTITION BY t.session_id, g.started_at, t.player_id
                            ORDER BY t.captured_at, t.id) - 1 AS n
  FROM eff t ASOF JOIN game g
    ON g.session_id = t.session_id AND t.captured_at >= g.started_at
  WHERE g.game_type = 'X01'"""

# base: score at the start of the turn; out: rest of the turn is void.
PARTS["x01_line"] = """
  SELECT session_id, started_at, player_id, CAST(-1 AS BIGINT) AS n, start_score AS remaining,
         start_score AS base, FALSE AS out, '' AS status
  FROM (SELECT DISTINCT session_id, started_at, player_id, start_score FROM x01_dart)
  UNION ALL
  SELECT session_id, started_at, player_id, n,
         CASE status WHEN 'scored' THEN left_over WHEN 'finish' THEN 0 WHEN 'bust' THEN base
              ELSE remaining END,
         base, out OR status = 'bust', status
  FROM (
    SELECT *, CASE WHEN remaining = 0 THEN 'after' WHEN out THEN 'void'
                   WHEN left_over = 0 AND (dbl OR NOT double_out) THEN 'finish'
                   WHEN left_over < 0 OR left_over = 0 OR (left_over = 1 AND double_out) THEN 'bust'
                   ELSE 'scored' END AS status
    FROM (
      SELECT d.session_id, d.started_at, d.player_id, d.n, d.dbl, d.double_out,
             l.remaining, l.remaining - d.score AS left_over,
             CASE WHEN d.n % 3 = 0 THEN l.remaining ELSE l.base END AS base,
             d.n % 3 <> 0 AND l.out AS out
      FROM x01_line l JOIN x01_dart d
        ON d.session_id = l.session_id AND d.started_at = l.started_at
       AND d.player_id = l.player_id AND d.n = l.n + 1))"""

PARTS["leg_end"] = """
  SELECT session_id, started_at, min(captured_at) AS ended
  FROM x01_line l JOIN x01_dart d USING (session_id, started_at, player_id, n)
  WHERE status = 'finish' GROUP BY ALL"""


def _cricket(source: str, leg: str) -> dict[str, str]:
    """Cricket by closing times. `source` has id, player_id, captured_at, segment, multiplier."""
    same = " AND ".join(f"a.{c} = b.{c}" for c in leg.split(", "))
    return {
        "c_throw": f"""
  SELECT {leg}, id, player_id, captured_at, segment,
         CASE WHEN segment >= 15 THEN multiplier ELSE 0 END AS marks,
         sum(CASE WHEN segment >= 15 THEN multiplier ELSE 0 END)
           OVER (PARTITION BY {leg}, player_id, segment ORDER BY captured_at, id) AS upto
  FROM {source}""",
        "c_close": f"""
  SELECT {leg}, player_id, segment, min(captured_at) AS closed_at FROM c_throw
  WHERE upto >= 3 GROUP BY ALL""",
        "c_player": f"SELECT DISTINCT {leg}, player_id FROM c_throw",
        "c_point": f"""
  SELECT a.*,
         CASE WHEN upto > 3 AND EXISTS (
           SELECT 1 FROM c_player b LEFT JOIN c_close c
             ON {same.replace("a.", "c.")} AND c.player_id = b.player_id AND c.segment = a.segment
           WHERE {same} AND b.player_id <> a.player_id
             AND (c.closed_at IS NULL OR c.closed_at > a.captured_at))
         THEN least(marks, upto - 3) * segment ELSE 0 END AS points
  FROM c_throw a""",
        "c_sum": f"""
  SELECT *, sum(points) OVER (PARTITION BY {leg}, player_id ORDER BY captured_at, id)
              AS points_so_far,
         (SELECT count(*) FROM c_close b WHERE {same} AND b.player_id = a.player_id
            AND b.closed_at <= a.captured_at) AS numbers_closed,
         EXISTS (SELECT 1 FROM c_close b WHERE {same} AND b.player_id = a.player_id
            AND b.segment = a.segment AND b.closed_at = a.captured_at) AS closes
  FROM c_point a""",
        "c_win": f"""
  SELECT a.*, numbers_closed = 7 AND NOT EXISTS (
           SELECT 1 FROM c_player p WHERE {same.replace("b.", "p.")} AND p.player_id <> a.player_id
             AND (SELECT coalesce(sum(points), 0) FROM c_point b
                  WHERE {same} AND b.player_id = p.player_id AND b.captured_at <= a.captured_at)
                 > a.points_so_far) AS wins
  FROM c_sum a""",
        "c_state": f"""
  SELECT a.*, coalesce(a.captured_at > b.won_at, FALSE) AS after
  FROM c_win a LEFT JOIN
    (SELECT {leg}, min(captured_at) AS won_at FROM c_win WHERE wins GROUP BY ALL) b
    ON {same}""",
    }


PARTS["issue"] = """
  SELECT p_partkey, 'r' || CAST(p_partkey // 100 AS VARCHAR) AS repo,
         p_partkey % 100 + 1 AS number, p_partkey % 100 = 0 AS is_map, p_size, p_name,
         CASE WHEN p_partkey % 100 = 0 THEN 'map'
              WHEN p_type = 'ECONOMY' THEN 'research' WHEN p_type = 'SMALL' THEN 'prototype'
              WHEN p_type = 'PROMO' THEN 'grilling' WHEN p_type = 'STANDARD' THEN 'task' END
           AS kind,
         CASE WHEN p_size % 3 = 0 THEN 'closed' ELSE 'open' END AS state,
         p_size % 5 = 0 AS assigned,
         CASE WHEN p_partkey % 100 = 0 THEN NULL WHEN p_size % 13 = 0 THEN 2 ELSE 1 END AS parent
  FROM part"""

PARTS["ticket"] = "SELECT * FROM issue WHERE kind <> 'map'"

PARTS["edge"] = """
  SELECT DISTINCT repo, number, blocker FROM (
    SELECT repo, number, unnest(CASE WHEN p_size % 17 = 0 THEN [1]
                                     WHEN p_partkey % 4 = 0 THEN []
                                     ELSE [number // 2, number // 3] END) AS blocker
    FROM issue WHERE NOT is_map)"""

PARTS["line"] = """
  SELECT 'r' || CAST(l_partkey // 100 AS VARCHAR) AS repo, l_partkey % 100 + 1 AS number,
         l_shipdate AS ts, l_linenumber = 1 AS claim,
         l_returnflag = 'R' AND l_linenumber = 7 AND l_linestatus = 'O' AS resolves
  FROM lineitem"""

# What each part reads from.
NEEDS = {
    "polar": ["ev"],
    "hit": ["polar"],
    "thr": ["hit"],
    "dirty_once": ["thr"],
    "dirty": ["dirty_once"],
    "broken": ["thr"],
    "faults": ["broken"],
    "det": ["ev"],
    "game": ["ev"],
    "winner": ["thr"],
    "chain": ["winner"],
    "ends": ["chain"],
    "eff": ["ends"],
    "pairs": ["eff"],
    "numbered": ["eff"],
    "turns": ["numbered"],
    "x01_dart": ["eff", "game"],
    "x01_line": ["x01_dart"],
    "leg_end": ["x01_line"],
    "ticket": ["issue"],
    "edge": ["issue"],
}


def _sql(
    body: str,
    *parts: str,
    extra: dict[str, str] | None = None,
    instead: dict[str, str] | None = None,
) -> str:
    """`body` with the parts it needs; `extra` come last, `instead` replaces parts."""
    wanted: list[str] = []
    known = PARTS | (instead or {})

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for part in parts:
        add(part)
    ctes = [f"{n} AS ({known[n]}\n)" for n in wanted]
    ctes += [f"{n} AS ({text}\n)" for n, text in (extra or {}).items()]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


def _turn_sum(source: str) -> str:
    return f"""
  SELECT session_id, player_id, turn_no, CAST(sum(score) AS BIGINT) AS turn_score,
         count(*) AS darts
  FROM (SELECT *, (row_number() OVER (PARTITION BY session_id, player_id
                                      ORDER BY captured_at, id) - 1) // 3 AS turn_no
        FROM {source}) GROUP BY ALL"""


_INV = """(a * e - b * d)"""
_H = [
    "(e - f * h)", "(c * h - b)", "(b * f - c * e)",
    "(f * g - d)", "(a - c * g)", "(c * d - a * f)",
    "(d * h - e * g)", "(b * g - a * h)", _INV,
]
_FORWARD = """
  SELECT calibration_id, s_suppkey, 300e0 AS a, 5e0 * i AS b, 640e0 AS c, 3e0 * i AS d,
         -300e0 AS e, 360e0 AS f, 0.01e0 * i AS g, 0.02e0 AS h FROM cal"""

ORACLES: dict[str, str] = {
    "s8_union_sources": _sql(
        "SELECT id, session_id, source, correction_of, score FROM thr", "thr"
    ),
    "p1_validate_throws": _sql("SELECT event_id, violations FROM faults", "faults"),
    "p2_split_valid": _sql("SELECT event_id, violations = '' AS good FROM faults", "faults"),
    "p3_vendor_leak": _sql(
        """SELECT CAST(event_id AS VARCHAR) AS id,
                  CASE WHEN event_type = 'click' THEN 'impact.' ELSE '' END || event_type AS leaked
           FROM ev WHERE event_type IN ('purchase', 'signup', 'click')""",
        "ev",
    ),
    "p4_route_confidence": _sql(
        """SELECT id, confidence, CASE WHEN confidence < 0.5e0 THEN 'review' ELSE 'accept' END
           AS route FROM thr""",
        "thr",
    ),
    "p5_visible_frames": """
        SELECT 'c' || CAST(s_suppkey AS VARCHAR) AS calibration_id, CAST(4 AS BIGINT) AS n_landmarks
        FROM supplier WHERE s_suppkey % 10 <> 8""",
    "p5_usable_frames": _sql(
        """SELECT session_id, event_id AS frame_no, event_id % 4 AS n_tips FROM ev
           WHERE event_id % 7 <> 0""",
        "ev",
    ),
    "p6_assemble_throws": _sql(
        """SELECT sha256(session_id || '|' || event_id || '|' || calibration_id) AS id, session_id,
                  player_id, segment, multiplier, score, notation, 'camera' AS source
           FROM hit""",
        "hit",
    ),
    "p7_to_adapter": _sql(
        """SELECT 'scores' AS adapter, id,
                  '{"field":"' || notation || '","thrower":"' || player_id || '","points":' || score
                  || ',"match":"' || session_id || '"}' AS payload
           FROM thr""",
        "thr",
    ),
    "p8_usable_datasets": """
        SELECT p_brand AS licence, p_name || '-' || CAST(p_partkey AS VARCHAR) AS dataset FROM part
        WHERE p_type <> 'PROMO' AND CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0""",
    "g12_dedupe_throws": _sql("SELECT id, score, source, correction_of FROM dirty_once", "dirty_once"),
    "j1_with_calibration": _sql(
        f"""SELECT throw_id, CAST(view AS INTEGER) AS view, calibration_id,
                   round({_H[0]} / {_INV}, 9) AS h0
            FROM det JOIN fwd USING (calibration_id)""",
        "det",
        "cal",
        extra={"fwd": _FORWARD},
    ),
    "j2_asof_calibration": _sql(
        """SELECT d.throw_id, CAST(d.view AS INTEGER) AS view, c.calibration_id
           FROM det d ASOF LEFT JOIN (SELECT * FROM cal WHERE validated_at IS NOT NULL) c
             ON c.session_id = d.session_id AND d.captured_at >= c.validated_at""",
        "det",
        "cal",
    ),
    "j3_asof_game": _sql(
        """SELECT t.id, g.game_type, g.start_score, g.double_out, g.started_at
           FROM thr t ASOF LEFT JOIN game g
             ON g.session_id = t.session_id AND t.captured_at >= g.started_at""",
        "thr",
        "game",
    ),
    "j4_orphan_calibration": _sql(
        """SELECT id, calibration_id FROM thr
           WHERE calibration_id NOT IN (SELECT calibration_id FROM cal)""",
        "thr",
        "cal",
    ),
    "j5_orphan_corrections": _sql(
        """SELECT id, correction_of FROM thr t WHERE correction_of IS NOT NULL
           AND NOT EXISTS (SELECT 1 FROM thr o WHERE o.id = t.correction_of)""",
        "thr",
    ),
    "j6_ring_lookup": _sql(
        "SELECT CAST(event_id AS VARCHAR) AS id, segment, multiplier FROM hit", "hit"
    ),
    "j7_authorised": _sql(
        """SELECT id, t.session_id FROM thr t
           JOIN (SELECT session_id, min(ts) FILTER (event_type = 'signup') AS lo,
                        max(ts) FILTER (event_type = 'purchase') AS hi FROM ev GROUP BY 1) g
             ON g.session_id = t.session_id AND captured_at >= lo AND captured_at <= hi""",
        "thr",
    ),
    "j8_close_groupings": _sql(
        """SELECT a.session_id, a.player_id, a.turn_no, a.id, b.id AS other_id, a.dart_no,
                  b.dart_no AS other_dart_no,
                  round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance
           FROM turns a JOIN turns b
             ON a.session_id = b.session_id AND a.player_id = b.player_id
            AND a.turn_no = b.turn_no AND a.dart_no < b.dart_no
           WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 0.25e0""",
        "turns",
    ),
    "j9_detected_vs_corrected": _sql(
        """SELECT id, final_id, detected_segment, corrected_segment, detected_score,
                  corrected_score, agree FROM pairs""",
        "pairs",
    ),
    "m1_fit_homography": _sql(
        "SELECT calibration_id, CAST(CASE s_suppkey % 10 WHEN 8 THEN 6 WHEN 9 THEN 5 ELSE 8 END"
        " AS INTEGER) AS rank, "
        + ", ".join(
            f"CASE WHEN s_suppkey % 10 < 8 THEN round({t} / {_INV}, 6) + 0e0 END AS h{n}"
            for n, t in enumerate(_H)
        )
        + " FROM fwd",
        "cal",
        extra={"fwd": _FORWARD},
    ),
    "m2_validate_calibration": _sql(
        """SELECT calibration_id, CAST(CASE WHEN i = 8 THEN 3 ELSE 4 END AS BIGINT) AS n_landmarks,
                  CASE WHEN i < 8 THEN 0e0 END AS rms, i < 8 AS valid FROM cal""",
        "cal",
    ),
    "m3_project_to_board": _sql(
        """SELECT throw_id, CAST(view AS INTEGER) AS view, round(bx, 6) + 0e0 AS x,
                  round(by0, 6) + 0e0 AS y
           FROM det WHERE calibration_id IN (SELECT calibration_id FROM cal)""",
        "det",
        "cal",
    ),
    "m4_map_segment": _sql(
        "SELECT CAST(event_id AS VARCHAR) AS id, segment, multiplier FROM hit", "hit"
    ),
    "m5_score": _sql("SELECT CAST(event_id AS VARCHAR) AS id, score FROM hit", "hit"),
    "m6_to_notation": _sql("SELECT CAST(event_id AS VARCHAR) AS id, notation FROM hit", "hit"),
    "m7_from_notation": _sql("SELECT id, notation, segment, multiplier FROM thr", "thr"),
    "g1_best_tip": _sql(
        """SELECT throw_id, CAST(view AS INTEGER) AS view, confidence FROM
             (SELECT *, row_number() OVER (PARTITION BY throw_id
                                           ORDER BY confidence DESC, frame_no) AS n FROM det)
           WHERE n = 1""",
        "det",
    ),
    "g2_fuse_views": _sql(
        """SELECT throw_id, round(sum(confidence * bx) / sum(confidence), 6) + 0e0 AS x,
                  round(sum(confidence * by0) / sum(confidence), 6) + 0e0 AS y,
                  max(confidence) AS confidence, count(*) AS n_views
           FROM det WHERE calibration_id IN (SELECT calibration_id FROM cal) GROUP BY 1""",
        "det",
        "cal",
    ),
    "g3_turn_totals": _sql(_turn_sum("eff"), "eff"),
    "g4_accuracy_report": _sql(
        """SELECT lighting, board, dart,
                  CAST(grouping(lighting) * 4 + grouping(board) * 2 + grouping(dart) AS BIGINT)
                    AS level,
                  count(*) AS throws, count(*) FILTER (agree) AS agreeing,
                  round(count(*) FILTER (agree) / CAST(count(*) AS DOUBLE), 9) AS accuracy
           FROM (SELECT agree, 'l' || n % 3 AS lighting, 'b' || n % 2 AS board, 'd' || n % 5 AS dart
                 FROM (SELECT agree, nullif(CAST(substr(session_id, 2) AS BIGINT),
                              CASE WHEN CAST(substr(session_id, 2) AS BIGINT) % 7 = 6
                                   THEN CAST(substr(session_id, 2) AS BIGINT) END) AS n FROM pairs))
           GROUP BY ROLLUP (lighting, board, dart)""",
        "pairs",
    ),
    "g5_confusion": _sql(
        """SELECT detected_segment, corrected_segment, count(*) AS throws FROM pairs
           GROUP BY ALL""",
        "pairs",
    ),
    "g6_impact_error": _sql(
        """SELECT count(*) AS throws, round(quantile_cont(distance, 0.5), 6) AS p50,
                  round(quantile_cont(distance, 0.95), 6) AS p95,
                  round(max(distance), 6) AS largest
           FROM pairs WHERE final_id <> id""",
        "pairs",
    ),
    "g6_sketched": _sql(
        """SELECT count(*) AS throws, round(max(distance), 6) AS largest, TRUE AS p50_holds,
                  TRUE AS p95_holds
           FROM pairs WHERE final_id <> id""",
        "pairs",
    ),
    "g11_sketched": """
        SELECT event_type AS runtime, date_trunc('day', ts)::TIMESTAMP AS window_start,
               count(*) AS frames, TRUE AS p50_holds, TRUE AS p95_holds
        FROM events GROUP BY 1, 2""",
    "s4_read_frames": _sql(
        """SELECT session_id, event_id AS frame_no, CAST(1 + event_id % 97 AS BIGINT) AS n_bytes,
                  md5(repeat(chr(65 + CAST(event_id % 26 AS INTEGER)), CAST(1 + event_id % 97 AS INTEGER)))
                    AS digest
           FROM ev""",
        "ev",
    ),
    "g7_threshold_sweep": _sql(
        """SELECT threshold, count(*) FILTER (confidence < threshold) AS in_review,
                  count(*) FILTER (confidence >= threshold AND NOT agree) AS missed_errors,
                  count(*) FILTER (confidence < threshold AND NOT agree) AS caught_errors
           FROM pairs, (SELECT unnest([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0]) AS threshold)
           GROUP BY 1""",
        "pairs",
    ),
    "g8_confidence_calibration": _sql(
        """SELECT CAST(least(floor(confidence * 10e0), 9) AS INTEGER) AS bin, count(*) AS throws,
                  round(avg(confidence), 9) AS mean_confidence,
                  round(avg(CASE WHEN agree THEN 1e0 ELSE 0e0 END), 9) AS agreement
           FROM pairs GROUP BY 1""",
        "pairs",
    ),
    "g9_correction_rate": _sql(
        """SELECT session_id, player_id, source,
                  CAST(grouping(session_id) * 4 + grouping(player_id) * 2 + grouping(source)
                       AS BIGINT) AS level,
                  count(*) AS events,
                  CAST(count(correction_of) AS BIGINT) AS corrections,
                  round(count(correction_of) / CAST(count(*) AS DOUBLE), 9) AS rate
           FROM thr GROUP BY GROUPING SETS ((session_id), (player_id), (source), ())""",
        "thr",
    ),
    "g10_calibration_friction": _sql(
        """SELECT session_id, attempts,
                  CASE WHEN first_valid IS NOT NULL THEN (
                    SELECT count(*) FROM ev e WHERE e.event_type = 'signup'
                      AND e.session_id = s.session_id AND e.ts <= s.first_valid) END
                    AS attempts_needed,
                  round((epoch_us(first_valid) - epoch_us(first_try)) / 1e6, 3) AS seconds_needed
           FROM (SELECT session_id, count(*) AS attempts, min(ts) AS first_try,
                        min(ts) FILTER (k >= 50) AS first_valid
                 FROM ev WHERE event_type = 'signup' GROUP BY 1) s""",
        "ev",
    ),
    "g11_runtime_report": """
        SELECT event_type AS runtime, date_trunc('minute', ts) AS window_start, count(*) AS frames,
               round(count(*) / 60e0, 6) AS frames_per_second,
               round(quantile_cont(value, 0.5), 6) AS latency_p50,
               round(quantile_cont(value, 0.95), 6) AS latency_p95
        FROM events GROUP BY 1, 2""",
    "w1_sample_frames": _sql(
        """SELECT session_id, epoch_us(ts) // 21600000000 AS slot, min(event_id) AS frame_no
           FROM ev GROUP BY 1, 2""",
        "ev",
    ),
    "w2_detect_throws": _sql(
        """SELECT session_id, frame_no, n_tips, new_tips, retrieved,
                  CAST(sum(new_tips) OVER (PARTITION BY session_id ORDER BY frame_no) AS BIGINT)
                    AS throws_so_far
           FROM (SELECT session_id, frame_no, n_tips,
                        CASE WHEN n_tips > was THEN n_tips - was ELSE 0 END AS new_tips,
                        was > 0 AND n_tips = 0 AS retrieved
                 FROM (SELECT session_id, event_id AS frame_no, event_id % 4 AS n_tips,
                              coalesce(lag(event_id % 4) OVER (PARTITION BY session_id
                                                               ORDER BY ts, event_id), 0) AS was
                       FROM ev))""",
        "ev",
    ),
    "w3_assign_turns": _sql("SELECT id, turn_no, dart_no FROM turns", "turns"),
    "w3_given_turns": _sql(
        """SELECT id, CAST(sum(CASE WHEN dart_no = 1 THEN 1 ELSE 0 END)
                           OVER (PARTITION BY session_id, player_id ORDER BY captured_at, id) - 1
                           AS BIGINT) AS turn_no, dart_no
           FROM (SELECT *, CAST((row_number() OVER (PARTITION BY session_id, player_id, island
                                                    ORDER BY captured_at, id) - 1) % 3 + 1
                                AS INTEGER) AS dart_no
                 FROM (SELECT *, sum(opens) OVER (PARTITION BY session_id, player_id
                                                  ORDER BY captured_at, id) AS island
                       FROM (SELECT *, CASE WHEN turn IS DISTINCT FROM lag(turn) OVER w
                                              OR lag(id) OVER w IS NULL THEN 1 ELSE 0 END AS opens
                             FROM (SELECT *, CASE WHEN CAST(session_id[2:] AS BIGINT) % 3 > 0
                                                  THEN 't' || (epoch_us(captured_at) // 1000000 // 40000)
                                             END AS turn FROM eff)
                             WINDOW w AS (PARTITION BY session_id, player_id ORDER BY captured_at, id))))""",
        "eff",
    ),
    "w4_running_score": _sql(
        """SELECT id, CAST(sum(score) OVER (PARTITION BY session_id, player_id
                                            ORDER BY captured_at, id) AS BIGINT) AS running_score
           FROM eff""",
        "eff",
    ),
    "w5_cricket_marks": _sql(
        """SELECT id, segment, CAST(marks AS INTEGER) AS marks,
                  CAST(least(upto, 3) AS BIGINT) AS marks_so_far FROM c_throw WHERE segment >= 15""",
        "eff",
        extra={"c_throw": _cricket("eff", "session_id")["c_throw"]},
    ),
    "w6_cricket_points": _sql(
        """SELECT id, CAST(points AS BIGINT) AS points, CAST(points_so_far AS BIGINT)
                    AS points_so_far, closes, numbers_closed, wins, after
           FROM c_state""",
        "eff",
        extra=_cricket("eff", "session_id"),
    ),
    "w7_scoreboard": _sql(
        """SELECT session_id, player_id, max(captured_at) AS captured_at,
                  arg_max(id, captured_at) AS id, CAST(sum(score) AS BIGINT) AS running_score,
                  count(*) AS n_throws
           FROM eff GROUP BY 1, 2""",
        "eff",
    ),
    "w8_worst_segments": _sql(
        """SELECT detected_segment, count(*) AS throws, count(*) FILTER (NOT agree) AS errors,
                  round(count(*) FILTER (NOT agree) / CAST(count(*) AS DOUBLE), 9) AS error_rate
           FROM pairs GROUP BY 1
           ORDER BY count(*) FILTER (NOT agree) / CAST(count(*) AS DOUBLE) DESC, 1 LIMIT 5""",
        "pairs",
    ),
    "r1_resolve_corrections": _sql("SELECT root, final_id, n_steps, status FROM ends", "ends"),
    "r2_effective_throws": _sql(
        """SELECT id, player_id, segment, multiplier, score, notation, confidence, final_id
           FROM eff""",
        "eff",
    ),
    "r3_correction_lineage": _sql(
        """SELECT s.root, CAST(s.step AS BIGINT) AS step, t.id, t.notation, t.score, t.confidence,
                  t.source
           FROM (SELECT root, id, step FROM chain
                 UNION ALL SELECT DISTINCT root, root, 0 FROM chain) s JOIN thr t ON t.id = s.id""",
        "chain",
    ),
    "r3_correction_history": _sql(
        """SELECT s.root, CAST(s.step AS BIGINT) AS step, t.id, t.notation, t.score, t.confidence,
                  t.source, s.step = 0 OR EXISTS (SELECT 1 FROM chain c
                                                  WHERE c.id = s.id AND c.root = s.root) AS in_force
           FROM (SELECT root, id, step FROM below
                 UNION ALL SELECT DISTINCT root, root, 0 FROM below) s JOIN thr t ON t.id = s.id""",
        "chain",
        extra={
            "below": """SELECT correction_of AS root, id, 1 AS step FROM thr
                        WHERE correction_of IS NOT NULL AND correction_of NOT IN
                            (SELECT id FROM thr WHERE correction_of IS NOT NULL)
                        UNION ALL SELECT b.root, t.id, b.step + 1 FROM below b
                        JOIN thr t ON t.correction_of = b.id"""
        },
    ),
    "e1_x01_states": _sql(
        """SELECT d.id, d.n // 3 AS turn_no, CAST(d.n % 3 + 1 AS INTEGER) AS dart_no,
                  CASE WHEN coalesce(d.captured_at > e.ended, FALSE) THEN NULL
                       ELSE CAST(l.remaining AS INTEGER) END AS remaining,
                  CASE WHEN d.captured_at > e.ended THEN 'after' ELSE l.status END AS status
           FROM x01_line l JOIN x01_dart d USING (session_id, started_at, player_id, n)
           LEFT JOIN leg_end e USING (session_id, started_at)""",
        "leg_end",
    ),
    "e2_cricket_standings": _sql(
        """SELECT session_id, started_at, player_id,
                  CAST(sum(CASE WHEN after THEN 0 ELSE points END) AS BIGINT) AS points,
                  count(*) FILTER (closes AND NOT after) AS numbers_closed,
                  count(*) FILTER (NOT after) AS darts, bool_or(wins AND NOT after) AS winner
           FROM c_state GROUP BY ALL""",
        "eff",
        "game",
        extra={
            "leg": """
  SELECT t.*, g.started_at FROM eff t ASOF JOIN game g
    ON g.session_id = t.session_id AND t.captured_at >= g.started_at
  WHERE g.game_type = 'Cricket'""",
            **_cricket("leg", "session_id, started_at"),
        },
    ),
    "e3_fold_game": _sql(
        """SELECT session_id, player_id, count(*) FILTER (score < 10) AS lost,
                  CAST(sum(CASE WHEN multiplier = 3 THEN 2 * score ELSE score END) AS BIGINT)
                    AS points
           FROM eff GROUP BY 1, 2""",
        "eff",
    ),
    "e3_fold_states": _sql(
        """SELECT session_id, player_id, arg_max(lives, n) AS lives FROM life GROUP BY 1, 2""",
        "eff",
        extra={
            "nth": """SELECT session_id, player_id, score, multiplier,
                             row_number() OVER (PARTITION BY session_id, player_id
                                                ORDER BY captured_at, id) AS n FROM eff""",
            "life": """SELECT session_id, player_id, 0::BIGINT AS n, 3 AS lives
                       FROM (SELECT DISTINCT session_id, player_id FROM eff)
                       UNION ALL
                       SELECT d.session_id, d.player_id, d.n,
                              CASE WHEN l.lives = 0 THEN 0 WHEN d.multiplier = 3 THEN least(l.lives + 1, 3)
                                   WHEN d.score < 10 THEN l.lives - 1 ELSE l.lives END
                       FROM life l JOIN nth d ON d.session_id = l.session_id
                         AND d.player_id = l.player_id AND d.n = l.n + 1""",
        },
    ),
    "e4_replay_diff": _sql(
        """SELECT *, 'a' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
           UNION ALL
           SELECT *, 'b' AS only_in FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
        "eff",
        extra={
            "camera": "SELECT * FROM thr WHERE correction_of IS NULL",
            "a": _turn_sum("camera"),
            "b": _turn_sum("eff"),
        },
    ),
    "i1_classify_issues": _sql("SELECT repo, number, kind FROM issue", "issue"),
    "i2_parse_ticket": _sql(
        """SELECT repo, number, CAST(1 AS BIGINT) AS parent, 'task' AS ticket_type,
                  CASE WHEN p_partkey % 4 = 0 THEN ''
                       WHEN number // 2 = number // 3 THEN CAST(number // 2 AS VARCHAR)
                       ELSE (number // 2) || ',' || (number // 3) END AS blockers
           FROM ticket""",
        "ticket",
    ),
    "i3_bad_questions": _sql(
        """SELECT repo, number, CAST(CASE WHEN p_size % 7 = 0 THEN 2 ELSE 0 END AS INTEGER)
                    AS n_questions
           FROM ticket WHERE p_size % 7 = 0 OR p_size % 11 = 0""",
        "ticket",
    ),
    "i4_map_sections": _sql(
        """SELECT repo, number, 'Out of scope' AS missing FROM issue
           WHERE is_map AND p_size % 2 = 0""",
        "issue",
    ),
    "i5_parents": _sql(
        "SELECT repo, number, CAST(parent AS BIGINT) AS parent FROM issue WHERE NOT is_map", "issue"
    ),
    "i6_blocking_edges": _sql(
        "SELECT repo, number, CAST(blocker AS BIGINT) AS blocker FROM edge", "edge"
    ),
    "i7_frontier": _sql(
        """SELECT repo, number FROM ticket t
           WHERE state = 'open' AND NOT assigned AND NOT EXISTS (
             SELECT 1 FROM edge e LEFT JOIN issue b ON b.repo = e.repo AND b.number = e.blocker
             WHERE e.repo = t.repo AND e.number = t.number AND coalesce(b.state, 'open') = 'open')""",
        "ticket",
        "edge",
    ),
    "i8_claim_audit": _sql(
        """SELECT repo, number, assigned_at, first_work FROM
             (SELECT repo, number, min(ts) FILTER (claim) AS assigned_at,
                     min(ts) FILTER (NOT claim) AS first_work FROM line GROUP BY 1, 2)
             JOIN ticket USING (repo, number)
           WHERE first_work IS NOT NULL AND NOT coalesce(assigned_at <= first_work, FALSE)""",
        "line",
        "ticket",
    ),
    "i9_resolution_audit": _sql(
        """SELECT repo, number, unnest(list_filter([
                    CASE WHEN NOT resolved THEN 'no_resolution' END,
                    CASE WHEN NOT listed THEN 'not_in_map' END,
                    CASE WHEN resolved AND listed AND p_size % 4 = 0 THEN 'pasted' END],
                    lambda f: f IS NOT NULL)) AS fault
           FROM (SELECT *, p_size % 6 = 0 AND parent = 1 AS listed,
                        EXISTS (SELECT 1 FROM line l WHERE l.repo = t.repo
                                AND l.number = t.number AND l.resolves) AS resolved
                 FROM ticket t WHERE state = 'closed')""",
        "ticket",
        "line",
    ),
    "i10_branch_audit": """
        SELECT 'r' || CAST(p_partkey // 100 AS VARCHAR) AS repo, p_partkey % 100 + 1 AS number,
               CASE WHEN p_type = 'PROMO' THEN 'prototype/old/' ELSE 'feature/' END
                 || replace(p_name, ' ', '-') AS name
        FROM part WHERE p_type <> 'SMALL'""",
    "i11_map_progress": _sql(
        """SELECT repo, CAST(parent AS BIGINT) AS parent, count(*) AS tickets,
                  count(*) FILTER (state = 'open') AS open_tickets,
                  count(*) FILTER (state = 'open') = 0 AS settled
           FROM ticket GROUP BY repo, parent""",
        "ticket",
    ),
}

_X01_SQL = """SELECT d.id, d.n // 3 AS turn_no, CAST(d.n % 3 + 1 AS INTEGER) AS dart_no,
                  CASE WHEN coalesce(d.captured_at > e.ended, FALSE) THEN NULL
                       ELSE CAST(l.remaining AS INTEGER) END AS remaining,
                  CASE WHEN d.captured_at > e.ended THEN 'after' ELSE l.status END AS status
           FROM x01_line l JOIN x01_dart d USING (session_id, started_at, player_id, n)
           LEFT JOIN leg_end e USING (session_id, started_at)"""
_LONG = """
  SELECT id, session_id, player_id, TIMESTAMP '2020-01-01' AS started_at, captured_at,
         CASE session_id WHEN 'L0' THEN 1001 ELSE 501 END AS start_score,
         session_id = 'L0' AS double_out, score, multiplier = 2 AS dbl,
         row_number() OVER (PARTITION BY session_id, player_id ORDER BY captured_at, id) - 1 AS n
  FROM (SELECT id, captured_at, score, multiplier,
               'L' || (CAST(substr(player_id, 2) AS BIGINT) // 2 % 2) AS session_id,
               'q' || (CAST(substr(player_id, 2) AS BIGINT) % 2) AS player_id
        FROM thr WHERE correction_of IS NULL)"""
# Throws by new tips, each with the next best tip of its frame, at its board point.
_SEEN = f"""
  SELECT *, row_number() OVER (PARTITION BY session_id, started_at, player_id
                               ORDER BY captured_at, id) - 1 AS n
  FROM (
    WITH seen AS (SELECT * FROM ({ORACLES["w2_detect_throws"]})),
    tried AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, view)
                AS place FROM det),
    dart AS (
      SELECT t.session_id, t.player_id, t.captured_at, t.bx AS x, t.by0 AS y, t.calibration_id,
             sha256(t.session_id || '|' || s.frame_no || '|' || t.calibration_id || '|'
                    || (s.throws_so_far - s.new_tips + t.place)) AS id
      FROM seen s JOIN tried t ON t.event_id = s.frame_no AND t.place <= s.new_tips
      WHERE t.calibration_id IN (SELECT calibration_id FROM cal)),
    polar AS ({PARTS["polar"].replace("FROM ev", "FROM dart")}),
    hit AS ({PARTS["hit"]})
    SELECT h.id, h.session_id, h.player_id, g.started_at, h.captured_at, g.start_score,
           g.double_out, h.score, h.multiplier = 2 AS dbl
    FROM hit h ASOF JOIN game g
      ON g.session_id = h.session_id AND h.captured_at >= g.started_at
    WHERE g.game_type = 'X01')"""
ORACLES |= {
    "e1_long_legs": _sql(_X01_SQL, "thr", "leg_end", instead={"x01_dart": _LONG}),
    "e5_frames_to_states": _sql(_X01_SQL, "det", "cal", "game", "leg_end", instead={"x01_dart": _SEEN}),
}

# In a stream an error corrects an event of its own session.
_LIVE = {
    "thr": PARTS["thr"]
    .replace(
        "CAST(event_id - 1 - k % 3 AS VARCHAR)",
        "coalesce(CAST(CASE k % 3 "
        + " ".join(
            f"WHEN {n} THEN lag(event_id, {n + 1}) OVER (PARTITION BY pair ORDER BY ts, event_id)"
            for n in range(3)
        )
        + " END AS VARCHAR), 'lost-' || event_id)",
    )
}
_LEG = """
  SELECT t.*, g.started_at FROM eff t ASOF JOIN game g
    ON g.session_id = t.session_id AND t.captured_at >= g.started_at
  WHERE g.game_type = 'Cricket'"""
_W2 = ORACLES["w2_detect_throws"]
_PAYLOAD = ORACLES["p7_to_adapter"]

ORACLES |= {
    "s1_read_throws": _sql(
        """SELECT id, session_id, captured_at, x, score, correction_of, NULL AS reason FROM thr
           WHERE event_id % 211 <> 0 AND event_id % 223 <> 0
           UNION ALL
           SELECT CASE WHEN event_id % 211 <> 0 THEN id END, NULL, NULL, NULL, NULL, NULL,
                  CASE WHEN event_id % 211 = 0 THEN 'malformed' ELSE 'captured_at' END
           FROM thr WHERE event_id % 211 = 0 OR event_id % 223 = 0""",
        "thr",
    ),
    "s2_stream_throws": _sql(
        """SELECT id, captured_at, notation, confidence, source FROM thr
           WHERE event_id % 211 <> 0 AND event_id % 223 <> 0""",
        "thr",
    ),
    "s2_stream_rejects": _sql(
        """SELECT CASE WHEN event_id % 211 <> 0 THEN id END AS id,
                  CASE WHEN event_id % 211 = 0 THEN 'malformed' ELSE 'captured_at' END AS reason,
                  CASE WHEN event_id % 211 = 0 THEN 'broken' ELSE '{"id":' END AS begins
           FROM thr WHERE event_id % 211 = 0 OR event_id % 223 = 0""",
        "thr",
    ),
    "s3_read_calibrations": _sql(
        f"""SELECT calibration_id, validated_at, round({_H[0]} / {_INV}, 9) AS h0
            FROM cal JOIN fwd USING (calibration_id)""",
        "cal",
        extra={"fwd": _FORWARD},
    ),
    "s3_read_landmarks": _sql(
        """SELECT calibration_id, name, bx, by0,
                  round((300e0 * bx + 5e0 * i * by0 + 640e0)
                        / (1e0 + 0.01e0 * i * bx + 0.02e0 * by0), 6) AS px
           FROM (SELECT calibration_id, i, name, bx,
                        CASE WHEN i = 9 THEN 0e0 ELSE by1 END AS by0
                 FROM cal, (VALUES ('n', 0e0, 1e0), ('e', 1e0, 0e0), ('s', 0e0, -1e0),
                                   ('w', -1e0, 0e0)) AS m(name, bx, by1)
                 WHERE i <> 8 OR name <> 'w')""",
        "cal",
    ),
    "s5_read_detections": _sql(
        """SELECT throw_id, CAST(view AS INTEGER) AS view, frame_no, captured_at, confidence
           FROM det""",
        "det",
    ),
    "s9_read_issues": _sql(
        """SELECT repo, number, state,
                  CAST(CASE WHEN NOT is_map AND p_size % 13 = 0 THEN 2 END AS BIGINT)
                    AS native_parent
           FROM issue""",
        "issue",
    ),
    "s6_store_throws": _sql(
        """SELECT CAST(captured_at AS DATE) AS capture_date, count(*) AS throws,
                  CAST(sum(score) AS BIGINT) AS points FROM thr GROUP BY 1""",
        "thr",
    ),
    "s7_publish": _PAYLOAD,
    "t1_live_scores": _sql(
        """SELECT l.session_id, l.started_at, l.player_id, 'X01' AS game_type,
                  CAST(arg_max(l.remaining, l.n) FILTER (coalesce(d.captured_at <= e.ended, TRUE))
                       AS INTEGER) AS value,
                  arg_max(CASE WHEN d.captured_at > e.ended THEN 'after' ELSE l.status END, l.n)
                    AS status,
                  CAST(count(*) AS INTEGER) AS throws
           FROM x01_line l JOIN x01_dart d USING (session_id, started_at, player_id, n)
           LEFT JOIN leg_end e USING (session_id, started_at) GROUP BY 1, 2, 3
           UNION ALL
           SELECT session_id, started_at, player_id, 'Cricket',
                  CAST(sum(CASE WHEN after THEN 0 ELSE points END) AS INTEGER),
                  CASE WHEN bool_or(wins AND NOT after) THEN 'winner' ELSE 'playing' END,
                  CAST(count(*) AS INTEGER)
           FROM c_state GROUP BY 1, 2, 3""",
        "leg_end",
        extra={"leg": _LEG, **_cricket("leg", "session_id, started_at")},
        instead=_LIVE,
    ),
    "t2_once_each": _sql("SELECT id, score, source FROM dirty_once", "dirty_once"),
    "t3_session_summary": _sql(
        """SELECT session_id, opened_at, closed_at, throws, points FROM (
             SELECT session_id, min(captured_at) AS opened_at,
                    max(captured_at) + INTERVAL 6 HOUR AS closed_at, count(*) AS throws,
                    CAST(sum(score) AS BIGINT) AS points
             FROM (SELECT *, sum(CASE WHEN captured_at < was + INTERVAL 6 HOUR THEN 0 ELSE 1 END)
                          OVER (PARTITION BY session_id ORDER BY captured_at) AS part
                   FROM (SELECT *, lag(captured_at) OVER (PARTITION BY session_id
                                                          ORDER BY captured_at) AS was FROM thr))
             GROUP BY session_id, part)""",
        "thr",
    ),
    "t4_live_frame_rate": """
        WITH hop AS (
          SELECT event_type AS runtime,
                 unnest([time_bucket(INTERVAL 30 MINUTE, ts),
                         time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start
          FROM events)
        SELECT runtime, window_start, count(*) AS frames, round(count(*) / 3600e0, 9) AS rate
        FROM hop GROUP BY 1, 2""",
    "t5_live_throws": _W2,
    "t6_with_stored_calibration": _sql(
        f"""SELECT throw_id, CAST(view AS INTEGER) AS view, round({_H[0]} / {_INV}, 9) AS h0
            FROM det JOIN fwd USING (calibration_id)""",
        "det",
        "cal",
        extra={"fwd": _FORWARD},
    ),
    "t6_with_arriving_calibration": _sql(
        f"""SELECT throw_id, CAST(view AS INTEGER) AS view, validated_at,
                   round({_H[0]} / {_INV}, 9) AS h0
            FROM det JOIN (SELECT calibration_id, validated_at FROM cal) USING (calibration_id)
            JOIN fwd USING (calibration_id)
            WHERE captured_at BETWEEN validated_at AND validated_at + INTERVAL 5 DAY""",
        "det",
        "cal",
        extra={"fwd": _FORWARD},
    ),
    "w1_live_sample": _sql(
        """SELECT session_id, time_bucket(INTERVAL 6 HOUR, ts) AS slot_start,
                  min(event_id) AS frame_no
           FROM ev GROUP BY 1, 2""",
        "ev",
    ),
    "t7_forward_live": f"""
        SELECT * FROM ({_PAYLOAD}) WHERE id IN (SELECT id FROM ({ORACLES["j7_authorised"]}))""",
    "t8_review_queue": ORACLES["p4_route_confidence"],
}

# X01 with turn ids: a turn begins where its id changes or after three darts.
_LEG_ORDER = "PARTITION BY session_id, started_at, player_id ORDER BY n"
_GIVEN_DART = f"""
  SELECT *, sum(CASE WHEN dart_no = 1 THEN 1 ELSE 0 END) OVER ({_LEG_ORDER}) - 1 AS turn_no
  FROM (SELECT *, CAST((row_number() OVER (PARTITION BY session_id, started_at, player_id, island
                                           ORDER BY n) - 1) % 3 + 1 AS INTEGER) AS dart_no
        FROM (SELECT *, sum(opens) OVER ({_LEG_ORDER}) AS island
              FROM (SELECT *, CASE WHEN n = 0 OR turn IS DISTINCT FROM lag(turn) OVER ({_LEG_ORDER})
                                   THEN 1 ELSE 0 END AS opens
                    FROM (SELECT *, CASE WHEN CAST(session_id[2:] AS BIGINT) % 3 > 0
                                         THEN 't' || (epoch_us(captured_at) // 1000000 // 40000)
                                    END AS turn
                          FROM ({PARTS["x01_dart"]})))))"""
ORACLES["e1_given_turns"] = _sql(
    """SELECT d.id, CAST(d.turn_no AS BIGINT) AS turn_no, d.dart_no,
              CASE WHEN coalesce(d.captured_at > e.ended, FALSE) THEN NULL
                   ELSE CAST(l.remaining AS INTEGER) END AS remaining,
              CASE WHEN d.captured_at > e.ended THEN 'after' ELSE l.status END AS status
       FROM x01_line l JOIN x01_dart d USING (session_id, started_at, player_id, n)
       LEFT JOIN leg_end e USING (session_id, started_at)""",
    "leg_end",
    instead={
        "x01_dart": _GIVEN_DART,
        "x01_line": PARTS["x01_line"].replace("d.n % 3 = 0", "d.dart_no = 1").replace("d.n % 3 <> 0", "d.dart_no <> 1"),
    },
)

# What arrives live gives what the stored tables give.
ORACLES |= {
    "r1_by_recursion": ORACLES["r1_resolve_corrections"],
    "t2_once_ever": ORACLES["t2_once_each"],
    "j2_live_asof_calibration": ORACLES["j2_asof_calibration"],
    "j3_live_asof_game": ORACLES["j3_asof_game"],
    "t1_live_scores_arriving_games": ORACLES["t1_live_scores"],
}
