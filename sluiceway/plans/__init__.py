"""Jobs, pipelines, schedules, versions and plugins around the operators."""
