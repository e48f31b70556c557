"""Word lists, patterns and thresholds that results depend on."""

DUPE_STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the to was were with will this these those after before "
    "into over under via about says said reported report breaking urgent update flash just now today live news"
).split()
BREAKING_HINTS = (
    "explosion strike airstrike drone missile killed dead casualties attack war mobilization evacuate evacuation state "
    "emergency earthquake flood wildfire blast hostage navy rescued"
).split()
GEO_HINTS = (
    "gaza rafah beirut tehran damascus aleppo kyiv odessa moscow baghdad hormuz bushehr iran iraq israel lebanon syria "
    "yemen ukraine russia"
).split()
SPAM_TERMS = ("airdrop", "giveaway", "promo code", "referral", "join now", "paid group", "vip", "dm for", "casino", "bet", "discount", "advertisement")
URL = r"(?i)https?://\S+|t\.me/\S+"
EMOJI = r"[\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]+"
CLOCK = r"(?i)\b(?:\d{1,2}[:.]\d{2}(?::\d{2})?\s?(?:utc|gmt|am|pm)?)\b"
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"
NOISE_WORDS = ("breaking", "urgent", "flash", "developing", "update", "news", "alert")
NOISE = rf"(?i)\b(?:{'|'.join(NOISE_WORDS)})\b"
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
SOURCE_TIER_BONUS = {"S": 0.35, "A": 0.24, "B": 0.14, "C": 0.06, "UNKNOWN": 0.04}
OBFUSCATION = ("@43!1|0$57#", "aaeiiiossti")
#: Words of a question that say nothing about its subject.
QUERY_GENERIC_TERMS = (
    "about after all also and any are as brief briefing can could current day days detail details did do does "
    "development developments digest explain find for from give has have happened happening headline headlines how "
    "hour hours into is its last latest lookup look me my news now of on or past please present query recent "
    "recently recap regarding report reports reply replying roundup search searching show situation status subject "
    "summary summarize overview than that the tell there this today top up update updates want was were what whats "
    "what's whatis which when where who would with why world global general going major big notable happen new "
    "everything anything channel channels feed feeds wire wires currently overall see stand stands you yesterday"
).split()

#: Words that show that a line is English, and words that show that it isn't (fixed values of the language gate).
ENGLISH_WORDS = (
    "a an and are as at after against amid before between by for from in into is it its of on or the their this to "
    "toward towards under was were while with within"
).split()
FOREIGN_CUES = ("kebakaran", "terjadi", "sebuah", "desa", "khushi", "leher", "paglus", "serangan", "warga", "pasukan", "pemerintah")

# Story facts (fixed values).
STORY_NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20",
}
CASUALTY_MARKERS = ("casualties", "casualty", "dead", "deaths", "fatalities", "fatality", "hurt", "injured", "injury", "killed", "wounded")
EVENT_COUNT_MARKERS = ("drone", "drones", "interceptor", "interceptors", "missile", "missiles", "projectile", "projectiles", "rocket", "rockets", "strike", "strikes")
OFFICIAL_MARKERS = ("confirmed", "confirms", "confirmation", "emergency services", "hospital", "magen david adom", "mda", "ministry", "official", "officials", "police", "spokesperson", "statement")
ACTORS = {
    "iran": ("iran", "iranian", "iran-backed"),
    "israel": ("israel", "israeli", "idf"),
    "hezbollah": ("hezbollah", "islamic resistance"),
    "hamas": ("hamas",),
    "houthis": ("houthi", "houthis", "ansar allah"),
    "united_states": ("u.s.", "u.s", "us", "american", "united states"),
    "mda": ("magen david adom", "mda"),
}
PHASES = {
    "launch": ("launch", "launches", "fired", "fire", "barrage", "salvo", "sirens"),
    "interception": ("intercept", "intercepted", "interception", "downed", "air defense"),
    "impact": ("impact", "impacts", "hit", "hits", "landed", "strike", "struck", "explosion", "blast"),
    "damage": ("damage", "damaged", "destroyed", "fire", "burning"),
    "casualties": ("casualties", "wounded", "injured", "dead", "killed", "fatalities", "hurt"),
    "retaliation": ("retaliation", "retaliatory", "response", "counterstrike", "counter-strike"),
}
BEFORE_PLACE = ("in", "near", "over", "at", "around", "outside", "south of", "north of", "east of", "west of", "off", "across", "toward", "towards")
BEFORE_TARGET = ("hit", "hits", "struck", "strike on", "strikes on", "targeted", "targets", "impact on", "impacts on", "attack on", "attacked")
TARGET_ENDS = ("according", "after", "amid", "as", "at", "for", "from", "in", "near", "on", "with")
PLACE_KINDS = ("area", "areas", "city", "district", "front", "governorate", "province", "region", "site", "town", "zone", "left", "leaves", "injured", "reports", "report", "say", "says", "wounded")
PLACE_FILLERS = ("after", "amid", "and", "as", "before", "during", "following", "for", "from", "into", "near", "on", "over", "toward", "towards", "with")
TOPIC_STOP_WORDS = "a after again amid an and another are as at be by for from in into is it its near of on over says say that the their this to was were with".split()
THREAD_STOP_WORDS = (
    "a an and are as at be by for from has have in into is it its of on or that the their this to was were with after "
    "before near over under says said reports report breaking urgent update developing live news"
).split()

# Trend of a conflict (fixed values).
TREND = {
    "escalating": ("escalating", "escalation", "intensifying", "intensified", "widening", "broader", "broadened", "expanded", "expanding", "stepped up", "more strikes", "fresh strikes", "another wave", "heavier", "higher tempo", "new wave", "wider front", "retaliation widened", "exchange widened"),
    "de-escalating": ("de-escalating", "deescalating", "de-escalation", "deescalation", "easing", "eased", "pace was lower", "lower than the earlier peak", "lower tempo", "slower pace", "reduced", "scaled back", "paused", "pause", "restraint", "not widening", "no widening", "held back", "cooling", "calmer", "diplomatic push", "ceasefire", "truce"),
    "mixed": ("mixed signals", "no clear shift", "no clear decisive shift", "still active but", "still active, but", "remains active but", "active but lower", "continued but lower", "still active"),
    "steady": ("strike", "strikes", "airstrike", "missile", "missiles", "drone", "drones", "launch", "launched", "salvo", "warning", "warnings", "alert", "alerts", "ceasefire", "truce", "talks", "negotiation", "negotiations", "diplomatic", "diplomacy", "official", "officials", "minister", "military", "army", "idf", "irgc"),
}
