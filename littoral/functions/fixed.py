"""Fixed values that results depend on: the hazard registry, word lists, weights, thresholds, places and texts."""

# Hazards in registry order: key, instrument variables that can bear a claim out, satellite recipe, words in official
# event names, English label of alerts.
HAZARDS = [
    ("coastal_flooding", ["water_level", "wave_height", "air_pressure"], "sentinel1_water_extent", ["coastal flood"], "Coastal flooding"),
    ("storm_surge", ["water_level", "wave_height", "air_pressure"], "sentinel1_water_extent", ["storm surge", "storm tide"], "Storm surge"),
    ("high_waves", ["wave_height", "water_level"], None, ["high wave", "high surf"], "High waves"),
    ("tsunami", ["water_level", "wave_height"], None, ["tsunami"], "Tsunami signs"),
    ("rip_current", ["wave_height"], None, ["rip current"], "Rip current"),
    ("oil_spill", [], "sentinel1_sar_dark_slick", ["oil spill"], "Oil spill"),
    ("algal_bloom", [], "sentinel2_ndci_anomaly", ["red tide", "algal bloom"], "Algal bloom"),
    ("erosion", ["wave_height", "water_level"], None, ["erosion"], "Coastal erosion"),
    ("other", ["water_level", "wave_height", "air_pressure"], None, [], "Coastal hazard"),
]

# Words that point to a hazard, by hazard.
KEYWORDS = {
    "coastal_flooding": ["flood", "under water", "water entering", "बाढ़", "पानी भर", "வெள்ளம்", "vellam", "paani bhar"],
    "storm_surge": ["surge", "cyclone", "storm", "तूफान", "புயல்", "puyal", "toofan"],
    "high_waves": ["wave", "swell", "लहर", "அலை", "alai", "lehar"],
    "tsunami": ["tsunami", "sea pulled back", "receded", "सुनामी", "சுனாமி", "sunami"],
    "rip_current": ["rip", "current", "dragged", "धारा", "நீரோட்டம்", "izhu"],
    "oil_spill": ["oil", "slick", "diesel", "तेल", "எண்ணெய்", "ennai"],
    "algal_bloom": ["algae", "bloom", "dead fish", "red water", "green water", "मछलियां मर", "மீன்கள் இற", "meen sethu"],
    "erosion": ["erosion", "sand washing", "coastline", "कटाव", "அரிப்பு", "arippu"],
}

# Words of urgent and of calm reports, and of second-hand ones.
URGENCY_HIGH = ["trapped", "help", "emergency", "drowning", "rising fast", "collapsing", "dying", "बचाओ", "मदद", "फंसे", "डूब", "உதவி", "மூழ்கு", "சிக்கி", "kaapathunga", "udhavi", "bachao", "madad"]
URGENCY_LOW = ["yesterday", "last week", "slowly", "small", "minor", "कल", "धीरे", "நேற்று", "மெதுவாக"]
HEARSAY = ["i heard", "someone said", "someone told me", "people are saying", "apparently", "according to", "they say", "rumor", "rumour", "heard that", "my friend said", "सुना है", "लोग कह रहे हैं", "कहा जा रहा है", "किसी ने बताया", "கேள்விப்பட்டேன்", "சொல்கிறார்கள்", "நண்பர் சொன்னார்", "கேள்விப்பட்டது"]

# Weights of the confidence components.
WEIGHTS = {"trust": 0.17, "coherence": 0.21, "instrument": 0.21, "media": 0.13, "satellite": 0.09, "account_device": 0.04, "official": 0.15}

# Scores of an official advisory's certainty; any other certainty scores OFFICIAL_DEFAULT.
CERTAINTY = {"Observed": 1.0, "Likely": 0.7, "Possible": 0.4, "Unknown": 0.2}
OFFICIAL_DEFAULT = 0.2

# Alert tiers from low to high.
TIERS = ["advisory", "watch", "warning"]

# Named places: name, latitude, longitude.
LANDMARKS = [
    ("Marina Beach", 13.0500, 80.2824),
    ("Besant Nagar / Elliot's Beach", 13.0002, 80.2669),
    ("Kasimedu fishing harbour", 13.1167, 80.2967),
    ("Injambakkam", 12.9243, 80.2472),
    ("Ennore", 13.2146, 80.3223),
]

# Tidal periods of the forecast, in hours.
TIDES = (12.42, 23.93)

# Damage from image statistics: least share of water for flooding, severe and destroyed; least share of edges for debris
# and severe debris.
WATER = (0.35, 0.50, 0.65)
EDGES = (0.18, 0.28)

# Texts of alerts by language, standard and short, with named gaps.
ALERT_TEXTS = {
    "en": ("{emoji} {tier}: {label} reported near your area ({n} report{plural}).", "{tier}: {label} near you ({n} report{plural})."),
    "ta": ("{emoji} {tier}: உங்கள் பகுதிக்கு அருகில் {label} தெரிவிக்கப்பட்டுள்ளது ({n} அறிக்கை{plural}).", "{tier}: {label} அருகில் ({n})."),
    "te": ("{emoji} {tier}: మీ ప్రాంతానికి సమీపంలో {label} నివేదించబడింది ({n} నివేదిక{plural}).", "{tier}: {label} సమీపంలో ({n})."),
}
TIER_MARKS = {"advisory": "\U0001f535", "watch": "\U0001f7e1", "warning": "\U0001f534"}

# Hazard labels in the other languages of alerts.
SPOKEN_LABELS = {
    "ta": {"coastal_flooding": "கடலோர வெள்ளம்", "storm_surge": "புயல் அலைப்பெருக்கு", "high_waves": "அதிக அலைகள்", "tsunami": "சுனாமி அறிகுறிகள்", "rip_current": "இழுவை நீரோட்டம்", "oil_spill": "எண்ணெய் கசிவு", "algal_bloom": "பாசி பெருக்கம் அல்லது மீன் இறப்பு", "erosion": "கடற்கரை அரிப்பு", "other": "வேறு ஆபத்து"},
    "te": {"coastal_flooding": "తీర వరదలు", "storm_surge": "తుఫాను ఉప్పెన", "high_waves": "ఎత్తైన అలలు", "tsunami": "సునామీ సూచనలు", "rip_current": "లాగే ప్రవాహం", "oil_spill": "చమురు లీకేజీ", "algal_bloom": "ఆల్గే వ్యాప్తి లేదా చేపల మరణం", "erosion": "తీర కోత", "other": "వేరే ప్రమాదం"},
}

# What the first entry of a hash chain follows.
GENESIS = "0" * 64
