"""Rule packs: a DataFrame of facts in, a DataFrame of findings out."""
