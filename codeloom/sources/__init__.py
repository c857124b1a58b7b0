"""Where facts come from: repositories, ignore rules, layer files, version control, hooks."""
