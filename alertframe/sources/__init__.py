"""alertframe.sources"""
