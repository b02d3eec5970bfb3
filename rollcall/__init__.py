"""rollcall: attendance analytics on Spark.

Awards, inactivity reports and a photo-archive manifest over the attendance
tables of many regions, each as one DataFrame plan for all regions.
"""
