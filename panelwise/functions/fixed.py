"""Names, labels, thresholds and constants that results depend on."""

# Spelling variants of entity names -> canonical name.
ALIASES = {
    "Andaman & Nicobar Islands": "Andaman And Nicobar Islands",
    "Jammu & Kashmir": "Jammu And Kashmir",
    "Dadra & Nagar Haveli": "Dadra And Nagar Haveli",
    "Daman & Diu": "Daman And Diu",
    "The Dadra And Nagar Haveli And Daman And Diu": "Dadra And Nagar Haveli And Daman And Diu",
    "Orissa": "Odisha",
    "Pondicherry": "Puducherry",
    "West  Bengal": "West Bengal",
    "West Bangal": "West Bengal",
    "Westbengal": "West Bengal",
    "West Bengli": "West Bengal",
    "Chhatisgarh": "Chhattisgarh",
    "Uttaranchal": "Uttarakhand",
}

# Entities merged after the aliases were applied.
MERGED = {
    "Dadra And Nagar Haveli": "Dadra And Nagar Haveli And Daman And Diu",
    "Daman And Diu": "Dadra And Nagar Haveli And Daman And Diu",
}

# Fixed value: entity text that stands for "missing".
SENTINEL = "100000"

# Profile labels, first match wins; the last entry is the default.
# (label, [(index, operator, threshold), ...])
LABEL_RULES = [
    ("Stable Mature System", [("maturity", ">", 0.7), ("volatility", "<", 0.3)]),
    ("High Maintenance Stress", [("pressure", ">", 0.7), ("volatility", ">", 0.7)]),
    ("Expansion Phase", [("maturity", "<", 0.4), ("pressure", "<", 0.4)]),
    ("Unpredictable - Needs Monitoring", [("predictability", "<", 0.3)]),
    ("Balanced / Transitional", []),
]

# Status and action, first match wins.
ACTION_RULES = [
    (
        "Mature-Overloaded",
        "Expand update capacity, decentralize service points, and introduce load-balancing.",
        [("maturity", "<", 0.3), ("pressure", ">", 0.6), ("volatility", ">", 0.5)],
    ),
    (
        "Stable Mature",
        "Optimize operations and invest in fraud detection plus service quality.",
        [("maturity", "<", 0.3), ("volatility", "<", 0.3)],
    ),
    (
        "Expansion Phase",
        "Increase enrollment infrastructure and run targeted outreach programs.",
        [("maturity", ">", 0.7), ("pressure", "<", 0.4)],
    ),
    (
        "Unpredictable System",
        "Increase monitoring and investigate administrative or reporting irregularities.",
        [("predictability", "<", 0.3)],
    ),
    ("Transitional", "Balance investment across enrollment and update services.", []),
]

# The older status rules, kept as an alternative rule set.
STATUS_RULES_V1 = [
    (
        "Stable Mature System",
        "Maintain baseline infrastructure; prioritize service quality audits",
        [("maturity", "<", 0.3), ("volatility", "<", 0.3)],
    ),
    (
        "High Maintenance Stress",
        "Deploy update-only centers; surge staffing; decentralize services",
        [("pressure", ">", 0.7), ("volatility", ">", 0.7)],
    ),
    (
        "Expansion Phase",
        "Expand enrollment through mobile units and institutional drives",
        [("maturity", ">", 0.7), ("pressure", "<", 0.4)],
    ),
    (
        "Unpredictable – Monitoring Required",
        "Implement monthly monitoring with flexible staffing buffers",
        [("predictability", "<", 0.3)],
    ),
    ("Balanced / Transitional", "Maintain mixed enrollment–update strategy", []),
]

# Quadrant names by (maturity above median, pressure above median).
QUADRANTS = {
    (False, True): "High Maintenance",
    (True, True): "Maintenance Stress",
    (False, False): "Stable & Mature",
    (True, False): "Expansion Phase",
}

# Band cut-offs (low below, high at or above) per index.
BANDS = {
    "maturity": (0.4, 0.7),
    "pressure": (0.4, 0.7),
    "volatility": (0.4, 0.7),
    "predictability": (0.3, 0.7),
}

# Weights of the priority score.
PRIORITY = {
    "pressure": 0.30,
    "volatility": 0.25,
    "unpredictability": 0.20,
    "flags": 0.15,
    "immaturity": 0.10,
}

# Preset lever settings (percent) per action text.
LEVERS = ["enrollment_drive", "fee_waiver", "mobile_linkage", "infrastructure_investment", "operator_training", "seasonal_uniformity"]
PRESETS = {
    "Balance investment across enrollment and update services.": [30.0, 20.0, 40.0, 20.0, 50.0, 40.0],
    "Optimize operations and invest in fraud detection plus service quality.": [10.0, 10.0, 30.0, 40.0, 80.0, 60.0],
    "Increase monitoring and investigate administrative or reporting irregularities.": [0.0, 0.0, 20.0, 10.0, 90.0, 30.0],
    "Increase enrollment infrastructure and run targeted outreach programs.": [70.0, 40.0, 30.0, 50.0, 40.0, 20.0],
    "Expand update capacity, decentralize service points, and introduce load-balancing.": [10.0, 30.0, 50.0, 70.0, 60.0, 70.0],
}

# Sensitivity of each lever family, floor and (offset, sign, index).
SENSITIVITY = {
    "enrollment": (0.1, 1.2, -1, "maturity"),
    "update": (0.2, 1.3, -1, "pressure"),
    "infra": (0.3, 0.5, 1, "volatility"),
    "temporal": (0.2, 1.2, -1, "predictability"),
}

# Effect terms (lever, maximum effect, rate, sensitivity family).
EFFECTS = {
    "maturity": [("enrollment_drive", 0.12, 2.5, "enrollment"), ("fee_waiver", 0.04, 2.0, "update")],
    "pressure": [("mobile_linkage", 0.18, 3.0, "update"), ("fee_waiver", 0.06, 2.0, "update")],
    "volatility": [("infrastructure_investment", 0.15, 2.0, "infra"), ("operator_training", 0.05, 2.5, "update")],
    "predictability": [("seasonal_uniformity", 0.20, 2.5, "temporal")],
    "demand": [
        ("enrollment_drive", 0.25, 2.0, "enrollment"),
        ("fee_waiver", 0.10, 2.0, "update"),
        ("mobile_linkage", 0.15, 2.5, "update"),
        ("infrastructure_investment", 0.08, 1.5, "infra"),
    ],
}

# Forecast band multipliers, capacity factor, constant criterion and label.
Z80, Z95, CAPACITY = 1.282, 1.960, 1.25
TREND_AIC, TREND_ORDER, TREND_SEASONAL = 999.0, "Fallback (Linear Regression)", "None"

# Fixed value: 5 % critical factor of the cumulative-sum break test.
CUSUM_CRITICAL = 1.358

# Fixed value: factor that makes the median absolute deviation estimate a normal sigma.
MAD_SIGMA = 1.4826

# Mixture profiles in the order that breaks equal scores, with their weights of
# (1, maturity, pressure, volatility, predictability, |maturity - 0.5|, |pressure - 0.5|).
PROFILE_WEIGHTS = {
    "Stable Mature System": (0, 1, 0, -1, 0, 0, 0),
    "High Maintenance Stress": (0, 0, 1, 1, 0, 0, 0),
    "Expansion Phase": (2, -1, -1, 0, 0, 0, 0),
    "Unpredictable System": (1, 0, 0, 0, -1, 0, 0),
    "Balanced / Transitional": (1, 0, 0, 0, 0, -1, -1),
}

# MacKinnon (1994) response surface, constant-only unit-root regression.
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL = [2.1659, 1.4412, 0.038269]
ADF_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]
