"""A closed-form score, so that decisions can be checked in SQL.

Coefficients of a linear form over the transformed features; the probability is its
logistic, rounded before any comparison.
"""

COEFFICIENTS = {
    "account_age_days": -0.15,
    "followers_count": -0.85,
    "following_count": 0.1,
    "follower_following_ratio": -0.35,
    "tweet_count": -0.1,
    "posting_frequency": 0.2,
    "description_length": 0.05,
    "username_length": -0.05,
    "profile_completeness": -0.25,
    "verified": 1.4,
    "uses_default_profile_image": 0.3,
    "has_description": -0.2,
}
INTERCEPT = -1.6
DIGITS = 6
MODEL_ID = "fixed_form"
