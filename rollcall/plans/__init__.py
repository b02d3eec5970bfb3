"""End-to-end jobs (award run, inactivity report, photo archive, catalogue set-up)."""
