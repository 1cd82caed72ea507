"""Word lists and lookup tables whose content decides results.

They are plain data; the order of entries matters where a comment says so.
"""

# Contraction rules, applied in this order.
CONTRACTION_RULES = [
    ("cannot ", "can not "),
    ("n't ", " n't "),
    ("n 't ", " n't "),
    ("ca n't", "can't"),
    ("ai n't", "ain't"),
    ("'m ", " 'm "),
    ("'re ", " 're "),
    ("'s ", " 's "),
    ("'ll ", " 'll "),
    ("'d ", " 'd "),
    ("'ve ", " 've "),
    (" p . m .", "  p.m."),
    (" p . m ", " p.m "),
    (" a . m .", " a.m."),
    (" a . m ", " a.m "),
]

# Emoticon -> emoji. One entry runs the other way, as in the data
# this table has to agree with.
EMOTICONS = {
    ":-)": "🙂",
    ":)": "🙂",
    ":-]": "🙂",
    ":]": "🙂",
    ":->": "😁",
    ":>": "😁",
    ":-D": "😃",
    ":D": "😃",
    "xD": "😆",
    "XD": "😆",
    "8-)": "😎",
    "8)": "😎",
    ":-3": "😺",
    ":3": "😺",
    ";-)": "😉",
    ";)": "😉",
    ":-P": "😛",
    ":P": "😛",
    ":-p": "😛",
    ":p": "😛",
    "xP": "😝",
    "XP": "😝",
    "😜": ";-P",
    ":-(": "🙁",
    ":(": "🙁",
    ":-[": "😞",
    ":[": "😞",
    ":-<": "😔",
    ":<": "😔",
    ":-c": "😖",
    ":c": "😖",
    ":'(": "😢",
    ";-(": "😢",
    "T_T": "😭",
    "T.T": "😭",
    ":-O": "😮",
    ":O": "😮",
    ":-o": "😯",
    ":o": "😯",
    "O_O": "😳",
    "o_o": "😳",
    "0_0": "😳",
    ">:[": "😡",
    ">:(": "😠",
    ":-/": "😕",
    ":/": "😕",
    ":-\\": "😕",
    ":\\": "😕",
    ":-|": "😐",
    ":|": "😐",
    "-_-": "😑",
    "-_-'": "😓",
    "<3": "❤️",
    "</3": "💔",
    "O:-)": "😇",
    "O:)": "😇",
    ">:-)": "😈",
    ">:)": "😈",
}

# Abbreviation -> expansion.
ABBREVIATIONS = {
    "lol": "laughing out loud",
    "lmao": "laughing my ass off",
    "lmfao": "laughing my fucking ass off",
    "rofl": "rolling on the floor laughing",
    "imo": "in my opinion",
    "imho": "in my humble opinion",
    "imao": "in my arrogant opinion",
    "omg": "oh my god",
    "smh": "shaking my head",
    "idk": "I don't know",
    "idc": "I don't care",
    "tbh": "to be honest",
    "ngl": "not gonna lie",
    "fr": "for real",
    "brb": "be right back",
    "gtg": "got to go",
    "g2g": "got to go",
    "ttyl": "talk to you later",
    "cya": "see ya",
    "btw": "by the way",
    "fyi": "for your information",
    "afaik": "as far as I know",
    "iirc": "if I recall correctly",
    "tldr": "too long; didn't read",
    "tl;dr": "too long; didn't read",
    "dm": "direct message",
}

# Public short names of the emojis the emoticon table produces,
# and of the one it consumes. Callers pass a larger table for other emojis.
EMOJI_NAMES = {
    "🙂": "slightly_smiling_face",
    "😁": "beaming_face_with_smiling_eyes",
    "😃": "grinning_face_with_big_eyes",
    "😆": "grinning_squinting_face",
    "😎": "smiling_face_with_sunglasses",
    "😺": "grinning_cat",
    "😉": "winking_face",
    "😛": "face_with_tongue",
    "😝": "squinting_face_with_tongue",
    "😜": "winking_face_with_tongue",
    "🙁": "slightly_frowning_face",
    "😞": "disappointed_face",
    "😔": "pensive_face",
    "😖": "confounded_face",
    "😢": "crying_face",
    "😭": "loudly_crying_face",
    "😮": "face_with_open_mouth",
    "😯": "hushed_face",
    "😳": "flushed_face",
    "😡": "enraged_face",
    "😠": "angry_face",
    "😕": "confused_face",
    "😐": "neutral_face",
    "😑": "expressionless_face",
    "😓": "downcast_face_with_sweat",
    "❤️": "red_heart",
    "💔": "broken_heart",
    "😇": "smiling_face_with_halo",
    "😈": "smiling_face_with_horns",
}

# Source label -> unified humanitarian label.
HUMANITARIAN_LABELS = {
    "not_related_or_irrelevant": "not_related_or_irrelevant",
    "not_humanitarian": "not_humanitarian",
    "Unknown": "unknown_or_unclassified",
    "unclassified": "unknown_or_unclassified",
    "Information source": "other_relevant_information",
    "Information Source": "other_relevant_information",
    "other_useful_information": "other_relevant_information",
    "other_relevant_information": "other_relevant_information",
    "displaced_people_and_evacuations": "displaced_people_and_evacuations",
    "infrastructure_and_utilities_damage": "infrastructure_and_utility_damage",
    "infrastructure_and_utility_damage": "infrastructure_and_utility_damage",
    "injured_or_dead_people": "injured_or_dead_people",
    "Casualties and damage": "injured_or_dead_people",
    "missing_trapped_or_found_people": "missing_trapped_or_found_people",
    "missing_or_found_people": "missing_trapped_or_found_people",
    "People missing, found or seen": "missing_trapped_or_found_people",
    "missing_and_found_people": "missing_trapped_or_found_people",
    "requests_or_urgent_needs": "requests_or_needs",
    "requests_or_needs": "requests_or_needs",
    "donation_needs_or_offers_or_volunteering_services": "rescue_volunteering_or_donation_effort",
    "Donations of money, goods or services": "rescue_volunteering_or_donation_effort",
    "donation_and_volunteering": "rescue_volunteering_or_donation_effort",
    "rescue_volunteering_or_donation_effort": "rescue_volunteering_or_donation_effort",
    "displaced_and_evacuations": "rescue_volunteering_or_donation_effort",
    "response_efforts": "rescue_volunteering_or_donation_effort",
    "sympathy_and_emotional_support": "sympathy_and_support",
    "sympathy_and_support": "sympathy_and_support",
    "affected_individuals": "affected_individuals",
    "affected_individual": "affected_individuals",
}

# Event spellings -> event name with its year.
EVENT_NAMES = {
    "Cyclone Idai": "2019 Cyclone Idai",
    "Ecuador Earthquake 2016": "2016 Ecuador Earthquake",
    "Hurricane Dorian": "2019 Hurricane Dorian",
    "Hurricane Florence": "2018 Hurricane Florence",
    "Hurricane Harvey": "2017 Hurricane Harvey",
    "Hurricane Irma": "2017 Hurricane Irma",
    "Hurricane Maria": "2017 Hurricane Maria",
    "Hurricane Matthew": "2016 Hurricane Matthew",
    "Midwestern US Floods": "2019 Midwestern US Floods",
    "california_wildfires": "2017 California Wildfires",
    "hurricane_harvey": "2017 Hurricane Harvey",
    "hurricane_irma": "2017 Hurricane Irma",
    "hurricane_maria": "2017 Hurricane Maria",
    "iraq_iran_earthquake": "2017 Iraq-Iran Earthquake",
    "mexico_earthquake": "2017 Puebla Mexico Earthquake",
    "srilanka_floods": "2017 Sri Lanka Floods",
}
