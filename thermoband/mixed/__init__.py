"""Periodic mixed-effects model with independent random slopes and AR(1) errors.

One Spark job reduces the readings to a small statistic per series; fitting
iterates over those statistics only, and the driver solves systems whose size
is the number of fixed effects.
"""
