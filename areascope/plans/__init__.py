"""The layered models (staging -> intermediate -> marts) and report queries."""
