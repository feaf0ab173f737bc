"""alertframe.streaming"""
