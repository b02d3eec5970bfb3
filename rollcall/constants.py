"""Fixed values.

Everything in this module must equal the values the source application uses,
otherwise results differ. They are stated plainly, in their natural order.
Nothing here is logic.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# fixed values: region selection
# ---------------------------------------------------------------------------
REGION_PREFIX = "f3"
# regions left out of the national post fact and the home-region counts
EXCLUDED_REGIONS_FACT = ("f3devcommunity", "f3development", "f3csra", "f3texarcana")
# regions left out when awards are handed out (adds one region to the list above)
EXCLUDED_REGIONS_AWARDS = ("f3devcommunity", "f3development", "f3csra", "f3texarcana", "f3yellowhammer")
# regions left out of the inactivity report
EXCLUDED_REGIONS_REPORT = ("f3devcommunity", "f3development", "f3csra")

# ---------------------------------------------------------------------------
# fixed values: row validity
# ---------------------------------------------------------------------------
NO_EMAIL = "none"
SYSTEM_USER_NAME = "PAXminer"
LOG_CHANNEL_AO = "paxminer_logs"

# ---------------------------------------------------------------------------
# fixed values: event classifier (patterns are matched against lower-cased text)
# ---------------------------------------------------------------------------
BACKBLAST_PREFIX_CHARS = 100
BACKBLAST_QSOURCE_PATTERN = r"q.{0,1}source|q{0,1}[1-9]\.[0-9]\s"
AO_QSOURCE_PATTERN = r"q.{0,1}source"
AO_NOT_WORKOUT_PATTERN = r"q.{0,1}source|ruck"

# ---------------------------------------------------------------------------
# fixed values: home region look-back windows, in days, in priority order
# ---------------------------------------------------------------------------
HOME_LOOKBACK_DAYS = (30, 60, 90, 120)

# ---------------------------------------------------------------------------
# fixed values: award catalogue, in id order (id = position, starting at 1)
# (name, description, verb, code)
# ---------------------------------------------------------------------------
AWARD_CATALOGUE = (
    ("The Priest", "Post for 25 Qsource lessons", "posting for 25 Qsource lessons", "the_priest"),
    ("The Monk", "Post at 4 QSources in a month", "posting at 4 Qsources in a month", "the_monk"),
    ("Leader of Men", "Q at 4 beatdowns in a month", "Qing at 4 beatdowns in a month", "leader_of_men"),
    ("The Boss", "Q at 6 beatdowns in a month", "Qing at 6 beatdowns in a month", "the_boss"),
    (
        "Be the Hammer, Not the Nail",
        "Q at 6 beatdowns in a week",
        "Qing at 6 beatdowns in a week",
        "be_the_hammer_not_the_nail",
    ),
    ("Cadre", "Q at 7 different AOs in a month", "Qing at 7 different AOs in a month", "cadre"),
    ("El Presidente", "Q at 20 beatdowns in a year", "Qing at 20 beatdowns in a year", "el_presidente"),
    ("El Quatro", "Post at 25 beatdowns in a year", "posting at 25 beatdowns in a year", "el_quatro"),
    ("Golden Boy", "Post at 50 beatdowns in a year", "posting at 50 beatdowns in a year", "golden_boy"),
    ("Centurion", "Post at 100 beatdowns in a year", "posting at 100 beatdowns in a year", "centurion"),
    ("Karate Kid", "Post at 150 beatdowns in a year", "posting at 150 beatdowns in a year", "karate_kid"),
    ("Crazy Person", "Post at 200 beatdowns in a year", "posting at 200 beatdowns in a year", "crazy_person"),
    ("6 pack", "Post at 6 beatdowns in a week", "posting at 6 beatdowns in a week", "6_pack"),
    ("Holding Down the Fort", "Post 50 times at an AO", "posting 50 times at an AO", "holding_down_the_fort"),
)

# fixed values: award rules, in id order
# (id, period, event class, leaders only, measure, default threshold)
#   period:  year | month | week | year_ao (year, per site)
#   class:   qsource | workout
#   measure: posts | sites (distinct sites)
AWARD_RULES = (
    (1, "year", "qsource", False, "posts", 25),
    (2, "month", "qsource", False, "posts", 4),
    (3, "month", "workout", True, "posts", 4),
    (4, "month", "workout", True, "posts", 6),
    (5, "week", "workout", True, "posts", 6),
    (6, "month", "workout", True, "sites", 7),
    (7, "year", "workout", True, "posts", 20),
    (8, "year", "workout", False, "posts", 25),
    (9, "year", "workout", False, "posts", 50),
    (10, "year", "workout", False, "posts", 100),
    (11, "year", "workout", False, "posts", 150),
    (12, "year", "workout", False, "posts", 200),
    (13, "week", "workout", False, "posts", 6),
    (14, "year_ao", "workout", False, "posts", 50),
)
SIX_PACK_AWARD_ID = 13

# ---------------------------------------------------------------------------
# fixed values: message templates
# ({bot} is the bot's display name, passed in by the caller)
# ---------------------------------------------------------------------------
AWARD_MESSAGE = (
    "Congrats to our man <@{pax}>! "
    "He just unlocked the achievement *{name}* for {verb} "
    "which he earned on {date}. "
    "This is achievement #{total} for <@{pax}> and the {nth}{suffix} "
    "time this year he's earned this award. Keep up the good work!"
)
SIX_PACK_REPEAT_MESSAGE = "Nice work brother. You just earned 6 pack for the {nth}{suffix} time this year!"
RUN_SUMMARY_MESSAGE = "Successfully ran today's {bot} achievements patch. Sent {n} new achievements."
REPORT_HEADER = "Howdy, <{target}>! This is your weekly {bot} Site Q report. According to my records..."
REPORT_MIA_HEADER = "\n\nThe following men haven't posted in a while."
REPORT_MIA_LINE = "\n- <@{user}> last posted {date}"
REPORT_LOWQ_HEADER = "\n\nThese guys haven't Q'd in a while. Here's how many days it's been:"
REPORT_LOWQ_LINE = "\n- <@{user}>: {days}!"
REPORT_NOQ_HEADER = "\n\nThese guys have never been Q:"
REPORT_NOQ_LINE = "\n- <@{user}>"
REPORT_DEFAULT_NOTE = (
    "\n\nNote: If you have listed your site Qs on your aos table, "
    "this information will have gone out to them as well."
)
REPORT_LOG_MESSAGE = "Successfully sent kotter reports"
# date format of the "last posted" line ("%B %d, %Y")
REPORT_DATE_FORMAT = "MMMM dd, yyyy"

# ---------------------------------------------------------------------------
# fixed values: photo archive
# ---------------------------------------------------------------------------
PHOTO_DESCRIPTION = "Posted by: {pax}\nPosted on: {date}\nPosted in:{channel}\n\n{text}"
PHOTO_DESCRIPTION_MAX_CHARS = 1000
# exif capture time ("%Y:%m:%d 06:30:00") and offset
PHOTO_EXIF_DATE_FORMAT = "yyyy:MM:dd '06:30:00'"
PHOTO_EXIF_OFFSET = "-06:00"
# GPS exif per site channel: (channel, {1: lat ref, 2: lat, 3: lon ref, 4: lon}),
# degrees / minutes / seconds as (numerator, denominator) rationals
SITE_GPS = (
    ("ao-the-last-stop", {1: "N", 2: ((38, 1), (45, 1), (349, 100)), 3: "W", 4: ((90, 1), (39, 1), (321, 100))}),
    ("ao-eagles-nest", {1: "N", 2: ((38, 1), (46, 1), (393, 100)), 3: "W", 4: ((90, 1), (32, 1), (5629, 100))}),
    ("ao-braveheart", {1: "N", 2: ((38, 1), (45, 1), (1482, 100)), 3: "W", 4: ((90, 1), (47, 1), (1011, 100))}),
    ("ao-pain-station", {1: "N", 2: ((38, 1), (48, 1), (5066, 100)), 3: "W", 4: ((90, 1), (41, 1), (988, 100))}),
    ("ao-the-bayou", {1: "N", 2: ((38, 1), (48, 1), (4513, 100)), 3: "W", 4: ((90, 1), (42, 1), (2114, 100))}),
    ("ao-running-with-animals", {1: "N", 2: ((38, 1), (44, 1), (657, 100)), 3: "W", 4: ((90, 1), (43, 1), (2267, 100))}),
    ("ao-the-darkness", {1: "N", 2: ((38, 1), (46, 1), (43, 100)), 3: "W", 4: ((90, 1), (34, 1), (1362, 100))}),
)

