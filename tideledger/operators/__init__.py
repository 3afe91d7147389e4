"""Operators over keyed daily series, rules, simulations and losses."""
